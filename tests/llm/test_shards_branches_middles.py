"""Hilbert shards, branch merges and fill-in-the-middle against brute force and odd inputs."""

import hashlib
import random
import re
import tracemalloc
import zlib
from itertools import pairwise, product

import pytest
from pyspark.sql import functions as F

from groundwell.llm import branch_merge, fill_in_middle, hilbert_shards, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, size string, n string, shard string"
TAIL = (1, "x", "y", "s", "n", "0")
LONG = "line of words\n" * 20_000
ODD = [
    (1, "a b\nc d\n\ne", "en", "s", *TAIL),
    (1, "a b\nc d\n\ne", "en", "s", *TAIL),
    (1, "another text of this id", None, "s", *TAIL),
    (2, None, None, None, None, None, None, None, None, None),
    (3, "", "en", "s", *TAIL),
    (4, "\n\n\n", "", "t", *TAIL),
    (5, LONG, "en", "s", *TAIL),
    (6, "x" * 50_000, "de", None, *TAIL),
    (7, "漢字🙂 é \x00 <P", "fr", "s", *TAIL),
    (8, "holds <M> itself", "fr", "s", *TAIL),
    (None, "nobody's text\nhere", "en", "s", *TAIL),
    (-3, "below zero", "en", "s", *TAIL),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# Fill in the middle


def middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middles_equal_brute_force_and_are_undone(spark, odd, small, empty):
    for docs in (odd, small):
        t = fill_in_middle.transformed(docs)
        got = t.withColumn("back", fill_in_middle.restored(F.col("form"), F.col("output"))).collect()
        rows = docs.select("doc_id", "text").collect()
        assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((middle(*r) for r in rows), key=repr)
        assert sorted(r["back"] for r in got) == sorted(r["text"] or "" for r in rows)
    assert fill_in_middle.transformed(empty).count() == 0


def test_middles_of_other_units_and_markers(spark):
    docs = spark.createDataFrame([(i, "ab cd\nef <P> gh " * 3) for i in range(40)], "k long, body string")
    marks = ("[pre.]", "[suf*]", "[mid]")
    t = fill_in_middle.transformed(docs, "k", "body", 7, 0, 50, marks, r"\w+|\W+")
    got = t.withColumn("back", fill_in_middle.restored(F.col("form"), F.col("output"), marks)).collect()
    assert {r["form"] for r in got} == {"psm", "spm"} and {r["n"] for r in got} == {30}
    assert {r["back"] for r in got} == {"ab cd\nef <P> gh " * 3}


def test_the_matcher_holds_no_units():
    text, unit = "word, " * 200_000, re.compile(fill_in_middle.UNIT)
    tracemalloc.start()
    n = fill_in_middle.counted(text, unit)
    places = fill_in_middle.walked(text, unit, n // 3, n - 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 600_000 and places == (400_001, 1_199_999) and most < 20_000


# Shards


@pytest.mark.parametrize(("dims", "bits"), [(2, 1), (2, 5), (3, 4), (4, 2)])
def test_the_curve_visits_every_cell_and_steps_to_a_neighbour(dims, bits):
    cells = sorted(product(range(1 << bits), repeat=dims), key=lambda p: hilbert_shards.curve_index(p, bits))
    assert sorted(hilbert_shards.curve_index(p, bits) for p in cells) == list(range(1 << bits * dims))
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in pairwise(cells))


def laid_out(docs, shards=24, levels=16):
    """Levels by counting, order by the curve, runs by division."""
    rows = [(d, t or "", l or "", s or "") for d, t, l, s in docs]
    keys = [(l, s, len(t.encode()) + 8) for _, t, l, s in rows]
    level = lambda i, v: sum(k[i] < v for k in keys) * levels // len(keys)
    curve = [hilbert_shards.curve_index(tuple(level(i, v) for i, v in enumerate(k)), 4) for k in keys]
    order = sorted(range(len(rows)), key=lambda j: (curve[j], rows[j][0] is not None, rows[j][0] or 0))
    out, seen = [], {}
    for rank, j in enumerate(order):
        shard = rank * shards // len(rows)
        out.append((rows[j][0], shard, seen.get(shard, 0), curve[j]))
        seen[shard] = seen.get(shard, 0) + 1
    return out


def test_shards_equal_brute_force(spark, odd, small, empty):
    got = hilbert_shards.sharded(small).collect()
    expected = laid_out(small.select("doc_id", "text", "lang", "source").collect())
    assert sorted((r["doc_id"], r["shard"], r["slot"], r["curve"]) for r in got) == sorted(expected)
    texts = dict(small.select("doc_id", "text").collect())
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]].encode()) + 8, zlib.crc32(texts[r["doc_id"]].encode())) for r in got)
    got = hilbert_shards.sharded(odd).collect()
    assert sorted(((r["shard"], r["slot"], r["curve"]) for r in got)) == sorted(x[1:] for x in laid_out(odd.select("doc_id", "text", "lang", "source").collect()))
    assert [(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 2] == [(8, 0)]
    assert hilbert_shards.sharded(empty).count() == 0


def test_shards_are_even_and_rule_files_out(spark, small, tmp_path):
    big = small.crossJoin(spark.range(20).withColumnRenamed("id", "copy")).withColumn("doc_id", F.col("doc_id") * 20 + F.col("copy")).drop("copy")
    s = hilbert_shards.sharded(big, shards=30).cache()
    sizes = [r["count"] for r in s.groupBy("shard").count().collect()]
    assert len(sizes) == 30 and max(sizes) - min(sizes) <= 1
    assert s.groupBy("shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count_distinct("slot").alias("n")).where("a != 0 OR b != n - 1").isEmpty()
    wide = big.withColumn("size", F.octet_length("text"))
    m = hilbert_shards.manifest(s, wide, ("lang", "source", "size")).collect()
    asked = [("en", "src3"), ("de", "src0"), ("fr", "src7")]
    met = [sum(r["least_lang"] <= l <= r["greatest_lang"] and r["least_source"] <= x <= r["greatest_source"] for r in m) for l, x in asked]
    assert sum(r["n_rows"] for r in m) == big.count() and sum(met) < 0.5 * len(m) * len(asked)
    path = str(tmp_path / "shards")
    hilbert_shards.written(big, s, path)
    back = spark.read.parquet(path)
    assert back.count() == big.count() and back.groupBy("shard").count().count() == 30
    assert back.select("doc_id", "shard").exceptAll(s.select("doc_id", "shard")).isEmpty()


def test_too_many_cells_fail(small):
    with pytest.raises(ValueError, match="bits"):
        hilbert_shards.sharded(small, bits=8)


# Branches


def merged(docs):
    """The contract, row by row and line by line."""
    base = {}
    for d, t, l, s in docs:
        base[d] = min(base.get(d, (t or "", l or "", s or "")), (t or "", l or "", s or ""))
    code = lambda b, d, name: zlib.crc32(f"{b}:{'' if d is None else d}:{name}".encode()) % 11
    out, added = {}, {}
    for d, (text, lang, source) in base.items():
        for b, k in (("L", -1), ("R", -2)):
            if d is not None and code(b, d, "row") in (3, 4):
                added.setdefault(k - d, set()).add(("!" if code(b, d, "row") == 3 else "?", lang, source))
        n = {"c": 0, "ee": 0, "ed": 0, "ii": 0}

        def settle(old, l, r, fight, n=n):
            """old: no change. l, r: new values."""
            if l == old and r == old:
                return old
            if l == old or r == old or l == r:
                n["c"] += 1
                return r if l == old else l
            n["ed" if fight == "ee" and None in (l, r) else fight] += 1
            return old

        edited = lambda c, x: {0: None, 1: x + "!", 2: x + "?"}.get(c, x)
        inserted = lambda c: {3: "!", 4: "?"}.get(c)
        lines, changed, columns = [], {"L": False, "R": False}, []
        for name, v in (("lang", lang), ("source", source)):
            new = {b: edited(code(b, d, name), v) or "" for b in "LR"}
            changed = {b: changed[b] or new[b] != v for b in "LR"}
            columns.append(settle(v, new["L"], new["R"], "ee"))
        for i, x in enumerate(text.split("\n")):
            c = {b: code(b, d, i) for b in "LR"}
            changed = {b: changed[b] or c[b] < 5 for b in "LR"}
            lines.append(settle(x, edited(c["L"], x), edited(c["R"], x), "ee"))
            lines.append(settle(None, inserted(c["L"]), inserted(c["R"]), "ii"))
        drop = {b: code(b, d, "row") == 0 for b in "LR"}
        if drop["L"] or drop["R"]:
            fought = drop["L"] and not drop["R"] and changed["R"] or drop["R"] and not drop["L"] and changed["L"]
            out[d] = (*((text, lang, source) if fought else (None,) * 3), int(not fought), 0, int(fought), 0)
        else:
            out[d] = ("\n".join(x for x in lines if x is not None), *columns, n["c"], n["ee"], n["ed"], n["ii"])
    for d, values in added.items():
        if d in out:
            out[d] = (*out[d][:6], out[d][6] + 1)
        else:
            out[d] = (*(min(values) if len(values) == 1 else (None,) * 3), int(len(values) == 1), 0, 0, int(len(values) > 1))
    return sorted(((d, *v) for d, v in out.items()), key=repr)


def coded(docs):
    return branch_merge.merged(docs, lambda rows: queries.coded_edits(rows, "L"), lambda rows: queries.coded_edits(rows, "R"))


def test_merges_equal_brute_force(spark, odd, small, empty):
    many = spark.createDataFrame([(i, "\n".join("abcdefgh"[: i % 9]), ["en", "", None][i % 3], "s") for i in range(600)], "doc_id long, text string, lang string, source string")
    for docs in (odd, small, many):
        got = coded(docs).drop("conflicts").collect()
        assert sorted((tuple(r) for r in got), key=repr) == merged(docs.select("doc_id", "text", "lang", "source").collect())
    assert coded(empty).count() == 0


def edits(dropped=(), lang=None, lines=None, gaps=None, head=None, added=None):
    """Edits of one small table: ids that go, a language for all, texts and insertions by line."""
    texts, after = lines or {}, gaps or {}

    def of_lines(key, old):
        new = lambda i: F.coalesce(*[F.when(i == k, branch_merge.edit(F.lit(v).cast("string"))) for k, v in texts.items()], branch_merge.untouched())
        gap = lambda i: F.coalesce(*[F.when(i == k, F.lit(v)) for k, v in after.items()], F.lit(None).cast("string"))
        return F.transform(old, lambda _, i: F.struct(new(i).alias("edit"), gap(i).alias("gap")))

    return lambda rows: branch_merge.Edits(
        lambda key: key.isin(*dropped) if dropped else F.lit(False),
        lambda key, name, old: F.lit(lang) if lang and name == "lang" else old,
        of_lines,
        head=(lambda key, old: F.lit(head)) if head else None,
        added=rows.sparkSession.createDataFrame(added, "doc_id long, text string, lang string, source string") if added else None,
    )


def test_tombstones_anchors_and_recorded_conflicts(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "en", "s")], "doc_id long, text string, lang string, source string")
    left = edits(lang="de", lines={0: None, 1: "B", 2: None}, gaps={0: "after a", 2: "x"}, head="top", added=[(9, "new", "en", "s")])
    right = edits(lang="fr", lines={1: "b2", 2: "C"}, gaps={2: "y"}, head="top", added=[(9, "new", "en", "s"), (1, "again", "en", "s")])
    got = {r["doc_id"]: r for r in branch_merge.merged(docs, left, right).collect()}
    one = got[1]
    # The dropped first line still holds what was put after it; b, c, the last gap, the language and the added row conflict.
    assert (one["text"], one["lang"]) == ("top\nafter a\nb\nc", "en")
    assert (one["n_clean"], one["n_edit_edit"], one["n_edit_delete"], one["n_insert_insert"]) == (3, 2, 1, 2)
    names = {c["name"]: (c["left"], c["right"]) for c in one["conflicts"]}
    assert names.pop("new") and names == {"lang": ("de", "fr"), "1": ("B", "b2"), "2": (None, "C"), "2+": ("x", "y")}
    assert (got[9]["text"], got[9]["n_clean"]) == ("new", 1)


def test_merging_is_the_same_from_both_sides(spark, small):
    a = coded(small).drop("conflicts")
    b = branch_merge.merged(small, lambda rows: queries.coded_edits(rows, "R"), lambda rows: queries.coded_edits(rows, "L")).drop("conflicts")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_row_drops(spark):
    docs = spark.createDataFrame([(i, "a\nb", "en", "s") for i in range(3)], "doc_id long, text string, lang string, source string")
    got = branch_merge.merged(docs, edits(dropped=(0, 1)), edits(dropped=(0,), lines={1: "B"})).orderBy("doc_id").collect()
    assert [(r["text"], r["n_clean"], r["n_edit_delete"]) for r in got] == [(None, 1, 0), ("a\nb", 0, 1), ("a\nB", 1, 0)]
    assert [c["name"] for c in got[1]["conflicts"]] == ["row"]


def test_random_merges(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice("ab") * rng.randrange(3) for _ in range(rng.randrange(12))), rng.choice(["", "en"]), rng.choice(["", "s"])) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted((tuple(r) for r in coded(docs).drop("conflicts").collect()), key=repr) == merged(rows)


# The pipeline on odd tables


@pytest.fixture(scope="module")
def pipeline_cases(spark, tmp_path_factory):
    """Odd rows with every column that a stage makes for itself, and no rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot long, Place string, ids string, kept string, row string, h string, _id string"
    tail = (1, 5, "p", "i", "k", "r", "h", "x")
    words = " ".join(f"word{i} stands here" for i in range(40))
    rows = [
        (1, words, "en", "s", *tail), (1, words, "en", "s", *tail), (2, None, None, None, *(None,) * 8), (3, "", "en", "s", *tail), (4, " \t\n", "xx", "t", *tail),
        (5, words + " and more", "en", None, *tail), (6, "x" * 20_000, "de", "s", *tail), (7, "漢字🙂▁ é", "fr", "s", *tail), (None, words + " of nobody", "en", "s", *tail), (8, f"{words}  ", "en", "t", *tail),
        (9, "word " * 30_000, "en", "s", *tail),
    ]
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/some/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{folder}/none/documents.parquet")
    return folder


def test_the_pipeline_on_odd_empty_and_clashing_tables(spark, pipeline_cases):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, f"{pipeline_cases}/some").collect()
    ids = [r["doc_id"] for r in got]
    # Of equal and near texts (1, 8; 5 and nobody's are near them) one stays; texts without words go.
    assert ids.count(1) == 1 and not set(ids) & {2, 3, 4, 8} and len(ids) == len({(r["slot"], r["place"]) for r in got})
    assert all(r["ids"] for r in got)
    assert corpus_pipeline.run(spark, f"{pipeline_cases}/none").count() == 0

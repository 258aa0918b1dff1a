"""Quality rules: counted base rules, then divergence from language references (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import WS, checkpointed, let, private_names

# Frequent function words of the supported languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "with", "was", "on", "be", "at"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "su"],
}
LONGEST_COMMON = max(len(w.encode()) for words in COMMON_WORDS.values() for w in words)
#: Character classes of the histogram. White space, what is in none of them, and the bytes that
#: UTF-8 needs beyond one a character are three more bins.
CLASSES = [r"\p{Lu}", "0-9", r".,;:!?'\x22()\-", r"#*$%&|<>"]
SYMBOLS, SPACES = 3, 4
BINS = len(CLASSES) + 3

MIN_WORDS = 50
#: Shorter texts are not held against the references: their histograms are mostly noise.
MIN_CHARS_FOR_CLASSES = 200
MIN_WORDS_FOR_WORDS = 100
MAX_CLASS_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.25
#: A reference needs this many texts, else its language is judged by the base rules alone.
MIN_REFERENCE_TEXTS = 20
#: Shares are summed as integers of this unit, so that sums do not depend on the order of rows.
UNIT = 1_000_000_000


def _members(text: Column, cls: str) -> Column:
    """Characters of a class. Its members are the rarer ones, so removing them is the quicker way."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{cls}]+", ""))).cast("long")


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit("other"))


#: Scripts that tell references of one language tag apart.
SCRIPTS = ["Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Bengali", "Thai", "Hangul", "Hiragana", "Katakana", "Han"]


def _script(text: Column) -> Column:
    """The script with the most characters, '' where there is none of SCRIPTS. Kana and Han are one."""
    size = lambda s: F.length(text) - F.length(F.regexp_replace(text, rf"\p{{Is{s}}}+", ""))
    japanese = ("Hiragana", "Katakana", "Han")
    counts = [F.struct(size(s).alias("n"), F.lit(s).alias("s")) for s in SCRIPTS if s not in japanese]
    counts.append(F.struct(sum(map(size, japanese), F.lit(0)).alias("n"), F.lit("Han").alias("s")))
    return let(F.array_max(F.array(*counts)), lambda m: F.when(m["n"] > 0, m["s"]).otherwise(F.lit("")))


def _reference_key(lang: Column, text: Column) -> Column:
    """The language itself; with its script where no word list makes it known; null where it is not told."""
    tag = F.lower(F.trim(lang))
    return F.when(lang.isin(*COMMON_WORDS), lang).when(tag != "", F.concat_ws("/", tag, _script(text)))


def _word_list(key: Column) -> Column:
    out = F.array().cast("array<string>")
    for lang, words in COMMON_WORDS.items():
        out = F.when(key == lang, F.array(*[F.lit(w) for w in words])).otherwise(out)
    return out


#: Up to this many repeated window ids are looked up by scanning; beyond it all windows are sorted.
FEW_REPEATS = 24


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are told apart by hashes first; those whose hash repeats are compared as text.
    """

    def of(w: Column) -> Column:
        ids = F.transform(
            F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
        )

        def counted(h: Column) -> Column:
            repeated = let(
                F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))
            )
            every = F.sequence(F.lit(0), F.size(h) - 1)
            spots = let(
                repeated,
                lambda d: F.when(
                    F.size(d) <= FEW_REPEATS, F.filter(every, lambda i: F.array_contains(d, F.get(h, i)))
                ).otherwise(every),
            )
            windows = F.sort_array(
                F.transform(
                    spots,
                    lambda i: F.struct(
                        F.get(h, i).alias("h"),
                        F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"),
                        i.alias("p"),
                    ),
                )
            )

            def covered(s: Column) -> Column:
                same = lambda x, j: F.coalesce(
                    (x["h"] == F.get(s, j)["h"]) & (x["t"] == F.get(s, j)["t"]), F.lit(False)
                )
                twice = F.filter(s, lambda x, i: ((i > 0) & same(x, i - 1)) | same(x, i + 1))
                return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

            # Different ids prove different windows.
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(windows, covered))

        return let(ids, counted)

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(words, of)).cast("long")


def _histograms(docs: DataFrame, text_col: str, lang_col: str | None) -> DataFrame:
    """Adds _text, _lang, _words, _n, _classes and _common (integer histograms)."""
    lang = F.col(lang_col) if lang_col else F.lit("other")
    df = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("_lang", _language(lang))
    # Splitting at every single white space also counts them.
    df = df.withColumn("_cells", F.split(F.regexp_replace("_text", r"[\x09-\x0D]", " "), " "))
    df = df.withColumn("_words", F.array_remove("_cells", ""))
    df = df.withColumn("_n", F.size("_words").cast("long"))
    df = df.withColumn("_chars", F.length("_text").cast("long"))
    # Most characters are small letters and spaces: without them the other classes cost little.
    df = df.withColumn("_rest", F.regexp_replace("_text", "[a-z ]+", ""))
    known = [_members(F.col("_rest"), c) for c in CLASSES] + [(F.size("_cells") - 1).cast("long")]
    df = df.withColumn("_known", F.array(*known))
    rest = F.col("_chars") - F.aggregate("_known", F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("_classes", F.concat("_known", F.array(rest, F.octet_length("_text") - F.col("_chars"))))
    common = let(
        _word_list(F.col("_lang")),
        lambda words: let(
            F.filter("_words", lambda w: (F.octet_length(w) <= LONGEST_COMMON) & F.array_contains(words, w)),
            lambda hits: F.transform(words, lambda c: (F.size(hits) - F.size(F.array_remove(hits, c))).cast("long")),
        ),
    )
    df = df.withColumn("_hits", common)
    seen = F.aggregate("_hits", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("_common", F.concat("_hits", F.array(F.col("_n") - seen)))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.floor(x * F.lit(UNIT) / total))


def _as_shares(r: DataFrame, width: int) -> DataFrame:
    """_lang, _ref_n and the histograms as arrays that sum to one, from a column for each bin."""
    as_array = lambda k, n: F.array_compact(F.array(*[F.col(f"{k}{i}") for i in range(n)]))
    share = lambda a: let(
        a,
        lambda v: F.transform(
            v, lambda x: x.cast("double") / F.aggregate(v, F.lit(0.0), lambda s, y: s + y.cast("double"))
        ),
    )
    return r.select(
        "_lang",
        "_ref_n",
        share(as_array("c", BINS)).alias("_ref_classes"),
        share(as_array("w", width)).alias("_ref_common"),
    )


def _references(h: DataFrame) -> DataFrame:
    """Mean histogram of each language over all texts that are long enough: at most five rows.

    Every text weighs the same, whatever its length.
    """
    h = h.where((F.col("_chars") >= MIN_CHARS_FOR_CLASSES) & (F.col("_n") >= MIN_WORDS))
    h = h.select("_lang", _shares(F.col("_classes")).alias("c"), _shares(F.col("_common")).alias("w"))
    width = max(map(len, COMMON_WORDS.values())) + 1
    sums = [F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(BINS)]
    sums += [F.sum(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(width)]
    r = h.groupBy("_lang").agg(F.count(F.lit(1)).alias("_ref_n"), *sums)
    return _as_shares(r, width)


def _robust_references(h: DataFrame) -> DataFrame:
    """Median over sources of each source's mean histogram, of texts that pass the base rules.

    Equal texts count once, for the first of their sources, and a source has one vote however many
    rows it holds, so that one hot source cannot move the reference of a language. Only sources of
    a language with three or more give that safety. Needs _source.
    """
    h = h.where((F.col("_chars") >= MIN_CHARS_FOR_CLASSES) & ~_base_failed() & F.col("_lang").isNotNull())
    width = max(map(len, COMMON_WORDS.values())) + 1
    h = h.select("_lang", "_source", F.xxhash64("_text").alias("_copy"), _shares(F.col("_classes")).alias("c"), _shares(F.col("_common")).alias("w"))
    bins = [f"{k}{i}" for k, n in (("c", BINS), ("w", width)) for i in range(n)]
    h = h.select("_lang", "_source", "_copy", *[F.get(b[0], F.lit(int(b[1:]))).alias(b) for b in bins])
    # Equal texts have equal shares: the greatest is any of them.
    h = h.groupBy("_lang", "_copy").agg(F.min("_source").alias("_source"), *[F.max(b).alias(b) for b in bins])
    h = h.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(b).alias(b) for b in bins])
    h = h.select("_lang", "_n", *[(F.col(b).cast("double") / F.col("_n")).alias(b) for b in bins])
    r = h.groupBy("_lang").agg(F.sum("_n").alias("_ref_n"), *[F.percentile(b, F.lit(0.5)).alias(b) for b in bins])
    return _as_shares(r, width)


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of a histogram of counts from a histogram of shares."""

    def of(p: Column) -> Column:
        half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
        terms = F.zip_with(p, reference, lambda a, b: (half(a, (a + b) / 2) + half(b, (a + b) / 2)) / 2)
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))

    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return let(F.transform(counts, lambda x: x.cast("double") / total), of)


def _prepared(docs: DataFrame, text_col: str, lang_col: str | None) -> DataFrame:
    private_names(docs, text_col, *([lang_col] if lang_col else []))
    inner = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
        F.col(text_col).alias("_t"),
        *([F.col(lang_col).alias("_l")] if lang_col else []),
    )
    return _histograms(inner, "_t", "_l" if lang_col else None)


def _base(h: DataFrame) -> DataFrame:
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{WS}]"))
    h = h.withColumn("_dups", let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"))
    return h.withColumn("_repeats", _repeat_words(F.col("_words")))


def _base_failed(min_words: int = MIN_WORDS) -> Column:
    return (F.col("_n") < min_words) | (100 * F.col("_repeats") > 50 * F.col("_n"))


def _verdicts(h: DataFrame, refs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    # The references are a table of one short row a language (and script).
    h = h.join(F.broadcast(refs), "_lang", "left")
    h = h.select(
        "row",
        F.col("_n").alias("n_words"),
        (F.col("_chars") - F.get("_classes", F.lit(SPACES))).alias("word_chars"),
        F.get("_classes", F.lit(SYMBOLS)).alias("n_symbols"),
        F.col("_dups").alias("n_dup_lines"),
        F.col("_repeats").alias("n_repeat_words"),
        _base_failed(min_words).alias("base_failed"),
        F.when(
            (F.col("_chars") >= MIN_CHARS_FOR_CLASSES) & (F.col("_ref_n") >= MIN_REFERENCE_TEXTS),
            js_distance(F.col("_classes"), F.col("_ref_classes")),
        ).alias("class_distance"),
        F.when(
            (F.col("_n") >= MIN_WORDS_FOR_WORDS) & (F.col("_ref_n") >= MIN_REFERENCE_TEXTS),
            js_distance(F.col("_common"), F.col("_ref_common")),
        ).alias("word_distance"),
    )
    near = (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (
        F.coalesce(F.col("word_distance"), F.lit(0.0)) <= MAX_WORD_DISTANCE
    )
    return h.withColumn("kept", ~F.col("base_failed") & near)


def judged(
    docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``carry`` columns under the struct ``row``, then the base counts, distances and verdict.

    Null text counts as empty: no words, base rule failed. A null or unknown language is judged
    against the reference of all such texts. Rows are judged one by one, so repeated rows and ids
    get equal verdicts; an empty table gives no rows; clashing column names stay inside ``row``.
    The counts of every text are taken once and kept without the texts while the references form.
    """
    h = _base(_prepared(docs, text_col, lang_col)).select(
        F.struct(*[F.col("row")[c].alias(c) for c in carry]).alias("row"),
        "_lang", "_n", "_chars", "_classes", "_common", "_dups", "_repeats",
    )
    h = checkpointed(h)
    return _verdicts(h, _references(h))


#: Texts of fewer than MIN_WORDS words that ``kept_rows`` does not reject for that may have one symbol to so many words.
WORDS_TO_A_SYMBOL = 10


def kept_rows(
    docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", source_col: str | None = "source", min_words: int = MIN_WORDS
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged. Texts are read twice and never shuffled.

    Texts of fewer than ``min_words`` words go. Where that is less than MIN_WORDS, the short texts that
    are left are mostly too short for histograms, so those with more than a symbol to ten words go too.

    Unlike ``judged``, whose SQL fixes plain means, rows are held against references that no single
    source can move; without ``source_col`` all rows are one source. Texts of other languages than those
    with word lists are held against texts of their own language and script only; where there are too few,
    or no language is given, the base rules alone decide.
    """
    private_names(docs, *([source_col] if source_col else []))
    h = _base(_prepared(docs, text_col, lang_col))
    lang = F.col("row")[lang_col].cast("string") if lang_col else F.lit(None).cast("string")
    h = h.withColumn("_lang", _reference_key(lang, F.col("_text")))
    source = F.col("row")[source_col].cast("string") if source_col else F.lit("")
    refs = _robust_references(h.withColumn("_source", F.coalesce(source, F.lit("")))).where(F.col("_ref_n") >= MIN_REFERENCE_TEXTS)
    v = _verdicts(h, refs, min_words)
    littered = (F.col("n_words") < MIN_WORDS) & (WORDS_TO_A_SYMBOL * F.col("n_symbols") > F.col("n_words"))
    return v.where(F.col("kept") & ~littered).select("row.*")

"""Vector search, merging of branches, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import storage
from ..config import DEFAULT, Config
from ..functions import text
from . import vector_blocks

FILTERED = ("statute", "manual")
DEFAULT_SOURCES = ("verdict", "statute", "manual")


def topk(queries: DataFrame, chunks: DataFrame, k: int, branches: list[str | None], metric: str = "cosine") -> DataFrame:  # J1, J3
    """query_id, branch (its place), chunk_key, dist, rank: exact neighbours of each query in each branch, ties by key.

    A branch is a source type, or None for all chunks; all branches are served by one pass over the chunks.
    Queries (query_id, embedding; one vector an id) are packed into blocks that meet blocks of chunks,
    so neither goes through the driver. Distances count to 12 digits. Null and empty vectors, and those
    that hold nulls, are nobody's neighbours and have none; vectors of several lengths fail the job.
    """
    asked = storage.stored(queries.where(vector_blocks.usable("embedding")).select("query_id", "embedding").dropDuplicates(["query_id"]))
    numbers = asked.agg(F.sum(F.size("embedding"))).first()[0] or 0
    filters = sorted({b for b in branches if b is not None})
    code = vector_blocks.codes(F.col("source_type"), filters) if filters else F.lit(vector_blocks.OTHER)
    rows = asked.repartition(-(-numbers // vector_blocks.QUERY_BLOCK) or 1, "query_id")
    q = vector_blocks.packed(rows.select(F.col("query_id").alias("key"), F.lit(0).alias("code"), F.col("embedding").alias("vector")), vector_blocks.QUERY_BLOCK)
    pool = chunks.where(vector_blocks.usable("embedding"))
    c = vector_blocks.packed(pool.select(F.col("chunk_key").alias("key"), code.alias("code"), F.col("embedding").alias("vector")), vector_blocks.CHUNK_BLOCK)
    return vector_blocks.met(q, c, k, [None if b is None else filters.index(b) for b in branches], metric, numbers)


def knn(queries: DataFrame, chunks: DataFrame, k: int, source_type: str | None = None, metric: str = "cosine") -> DataFrame:  # J1
    """(query_id, chunk_key, dist, rank): ``topk`` of one branch."""
    return topk(queries, chunks, k, [source_type], metric).drop("branch")


def source_of(branch: Column, meta_source: Column, section_type: Column) -> Column:  # P3
    own = F.coalesce(F.nullif(meta_source, F.lit("")), F.when(F.coalesce(section_type, F.lit("")) != "", "verdict").otherwise("unknown"))
    return F.when(branch.isin(*FILTERED), branch).otherwise(own)


def chunk_id(doc_id: Column, rank: Column) -> Column:  # P4
    return F.concat(F.coalesce(doc_id, F.lit("")), F.lit("_"), (rank - 1).cast("string"))


def short_label(source: Column, meta) -> Column:  # P6
    """``meta`` maps a metadata key to its column."""
    part = lambda k: F.coalesce(meta(k), F.lit(""))
    build = lambda tag, a, b: text.strip(F.concat(F.lit(tag), part(a), F.lit(" "), part(b)))
    return (
        F.when(source == "statute", build("[법령] ", "law_name", "article_id"))
        .when(source == "manual", build("[매뉴얼] ", "part", "section_label"))
        .when(source == "law_api", build("[Open API] ", "law_name", "article_id"))
        .otherwise(build("[판결문] ", "case_number", "section_type"))
    )


def first_by_prefix(rows: DataFrame, by: list[str], order: list, chars: int = DEFAULT.dedup_chars) -> DataFrame:  # D1
    """Of rows whose texts agree in their first characters, the one first in ``order`` stays."""
    w = Window.partitionBy(*by, F.left("text", F.lit(chars))).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def retrieve(
    queries: DataFrame, chunks: DataFrame, sources: tuple[str, ...] = DEFAULT_SOURCES, config: Config = DEFAULT, n: int | None = None, metric: str = "cosine"
) -> DataFrame:  # J2, J3
    """query_id, position, branch, branch_rank, chunk_id, score, source_type and all columns of chunks.

    Statute and manual branches are filtered by source; any other name searches everything.
    """
    n = config.hits_per_source if n is None else n
    names = list(sources or DEFAULT_SOURCES)
    found = topk(queries, chunks, n, [b if b in FILTERED else None for b in names], metric)
    branch = F.get(F.array(*[F.lit(b) for b in names]), F.col("branch"))
    hits = found.select("query_id", "chunk_key", "dist", F.col("rank").alias("branch_rank"), branch.alias("branch"), F.col("branch").alias("branch_order"))
    own = "metadata" in chunks.columns
    hits = hits.join(chunks.drop("embedding"), "chunk_key")
    meta = (lambda k: F.col("metadata")[k]) if own else (lambda k: F.lit(None).cast("string"))
    hits = hits.withColumn("score", F.round(1 - F.col("dist"), 4))
    hits = hits.withColumn("source_type", source_of(F.col("branch"), F.col("source_type"), meta("section_type")))
    hits = hits.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("branch_rank")))
    hits = hits.where(F.col("score") >= config.score_threshold)
    hits = first_by_prefix(hits, ["query_id"], ["branch_order", "branch_rank"], config.dedup_chars)
    return ranked(hits, config.total_hits)


def ranked(hits: DataFrame, cap: int) -> DataFrame:  # O1, O3, W1
    """Stable order by score, best first; the earlier branch and rank break ties."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "branch_order", "branch_rank")
    return hits.withColumn("position", F.row_number().over(w)).where(F.col("position") <= cap)


def api_chunks(laws: DataFrame, articles: DataFrame, config: Config = DEFAULT, per_law: int | None = None) -> DataFrame:  # S7
    """Statute rows of each query. laws: query_id, ord, law_id, law_name; articles: law_id, ord, no, title, content.

    The first articles of a law are taken before those without content are left out.
    """
    k = config.api_articles if per_law is None else per_law
    l = laws.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))).where(F.col("_n") <= config.api_laws)
    l = l.where(F.coalesce("law_id", F.lit("")) != "")
    a = articles.withColumn("_m", F.row_number().over(Window.partitionBy("law_id").orderBy("ord"))).where(F.col("_m") <= k)
    a = a.where(F.coalesce("content", F.lit("")) != "")
    j = l.select("query_id", "_n", "law_id", "law_name").join(a.select("law_id", "_m", "no", "title", "content"), "law_id")
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" ("), F.col("title"), F.lit(")"))).otherwise(F.lit(""))
    return j.select(
        "query_id",
        F.concat(F.lit("api_"), "law_id", F.lit("_"), "no").alias("chunk_id"),
        F.concat(F.lit("【"), "law_name", F.lit("】 제"), "no", F.lit("조"), title, F.lit("\n"), "content").alias("text"),
        F.lit(config.api_score).alias("score"),
        F.lit("law_api").alias("source_type"),
        F.create_map(F.lit("law_name"), "law_name", F.lit("law_id"), "law_id", F.lit("article_id"), F.concat(F.lit("제"), "no", F.lit("조")), F.lit("source_type"), F.lit("law_api")).alias("metadata"),
        (F.col("_n") * 1000 + F.col("_m")).cast("int").alias("branch_rank"),
    )


def summary(api: DataFrame) -> DataFrame:  # A6, A7
    """query_id, n_chunks, laws: how many statute rows a query has, and of which laws (distinct, sorted)."""
    return api.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_set(F.col("metadata")["law_name"])).alias("laws"))


def with_api(hits: DataFrame, api: DataFrame | None, config: Config = DEFAULT) -> DataFrame:  # J4, S9
    """Hits and statute rows together: dedup again, order again, cap the total. No register (None): hits alone."""
    if api is None:
        return hits
    columns = ["query_id", "chunk_id", "text", "score", "source_type", "metadata"]
    both = hits.select(*columns, F.lit(0).alias("branch_order"), F.col("position").alias("branch_rank")).unionByName(
        api.select(*columns, F.lit(1).alias("branch_order"), "branch_rank")
    )
    both = first_by_prefix(both, ["query_id"], ["branch_order", "branch_rank"], config.dedup_chars)
    return ranked(both, config.total_hits + config.extra_api_hits)


def search_only(queries: DataFrame, chunks: DataFrame, n: int = 5, config: Config = DEFAULT, api: DataFrame | None = None) -> DataFrame:  # C11
    """Labelled hits; ``api`` (of ``api_chunks``) adds statute rows. Queries are embedded from their expanded texts."""
    hits = with_api(retrieve(queries, chunks, config=config, n=n), api, config)
    label = short_label(F.col("source_type"), lambda k: F.col("metadata")[k])
    return hits.select(
        "query_id", F.col("position").alias("rank"), "score", "source_type", label.alias("label"), text.preview(F.col("text"), config.preview_chars).alias("preview")
    )

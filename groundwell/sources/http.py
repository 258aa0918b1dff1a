"""Python data sources for the public registers, and the adapters that fill model-output tables.

Transports are injected by dotted name, so that tests and air-gapped runs read fixtures.
"""

from __future__ import annotations

import importlib
import json
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .. import storage
from ..config import PRECEDENT_FIELDS, PRECEDENT_KEYS, SUPREME_COURT


#: Seconds that a register of statutes may take to answer.
STATUTE_TIMEOUT = 10.0


def call(name: str) -> Callable:
    module, _, attribute = name.rpartition(".")
    return getattr(importlib.import_module(module), attribute)


def within(seconds: float, f: Callable, *args):
    """What ``f`` gives, or TimeoutError. The thread of a call that is given up goes on by itself."""
    out: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            out.put((True, f(*args)))
        except BaseException as e:
            out.put((False, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        ok, value = out.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds} s") from None
    if not ok:
        raise value
    return value


def as_list(value) -> list:
    """The registers send a lone row in place of a list of one."""
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def listing_ids(body: dict) -> list[str]:  # S1
    """Ids of a listing page; any unexpected shape is an empty page (a lone row included)."""
    rows = body.get("PrecSearch", {}).get("prec") if isinstance(body, dict) else None
    return [r["판례일련번호"] for r in rows] if isinstance(rows, list) else []


def detail_row(body: dict) -> tuple | None:  # S2
    inner = body.get("PrecService") if isinstance(body, dict) else None
    if inner is None:
        return None
    return tuple(str(inner.get(PRECEDENT_KEYS.get(f, f), "")) for f in PRECEDENT_FIELDS)


class Pages(InputPartition):
    def __init__(self, numbers: list[int]) -> None:
        self.numbers = numbers


class PrecedentReader(DataSourceReader):  # S1, S3
    """By default one partition: the register is asked slowly and in order, and the first empty page ends it.

    With ``parallel`` each page is a partition, and an empty page ends only itself.
    """

    def __init__(self, options: dict) -> None:
        self.fetch = options["transport"]
        self.query = options.get("query", "")
        self.pages = int(options.get("pages", 3))
        self.delay = float(options.get("delay", 0.2))
        self.parallel = str(options.get("parallel", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        numbers = list(range(1, self.pages + 1))
        return [Pages([n]) for n in numbers] if self.parallel else [Pages(numbers)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        fetch = call(self.fetch)
        for page in partition.numbers:
            try:
                ids = listing_ids(fetch("list", {"query": self.query, "page": page}))
            except Exception:  # an errored page reads as an empty one
                ids = []
            if not ids:
                return
            for i in ids:
                time.sleep(self.delay)
                try:
                    row = detail_row(fetch("detail", {"ID": i}))
                except Exception:  # a failed detail is left out
                    row = None
                if row is not None:
                    yield row


class PrecedentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "precedents"

    def schema(self) -> str:
        return ", ".join(f"`{f}` string" for f in PRECEDENT_FIELDS)

    def reader(self, schema) -> DataSourceReader:
        return PrecedentReader(self.options)


def supreme(rows: DataFrame) -> DataFrame:  # P25
    return rows.where(F.col("법원명") == SUPREME_COURT)


def append_jsonl(rows: DataFrame, path: str, distinct: bool = False) -> None:  # S4
    """Rows as JSON lines after those that ``path`` holds. With ``distinct`` no id comes twice, also not in later runs."""
    if distinct:
        key = PRECEDENT_FIELDS[0]
        rows = rows.dropDuplicates([key])
        if storage.exists(rows.sparkSession, path):
            there = rows.sparkSession.read.schema(f"`{key}` string").json(path).select(key)
            rows = storage.stored(rows.join(there, key, "left_anti").select(*rows.columns))
    rows.write.mode("append").json(path)


class Keys(InputPartition):
    def __init__(self, values: list[str]) -> None:
        self.values = values


class StatuteReader(DataSourceReader):  # S5, S6
    """Answers of a register for the keys that a filter names, a partition for each ``block`` of them."""

    def __init__(self, options: dict) -> None:
        self.transport = options["transport"]
        self.display = int(options.get("display", 5))
        self.block = int(options.get("block", 100))
        self.timeout = float(options.get("timeout", STATUTE_TIMEOUT))
        self.keys: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            own = getattr(f, "attribute", None) == (self.key,)
            if own and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = sorted(v for v in (values if self.keys is None else values & set(self.keys)) if v is not None)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.keys is None:
            raise ValueError(f"a register answers questions: filter by {self.key} (and set spark.sql.python.filterPushdown.enabled)")
        return [Keys(self.keys[i : i + self.block]) for i in range(0, len(self.keys), self.block)] or [Keys([])]

    def read(self, partition: Keys) -> Iterator[tuple]:
        fetch = call(self.transport)
        for key in partition.values:
            try:
                rows = self.asked(fetch, key)
            except Exception:  # failures and late answers are empty results
                rows = []
            yield from rows


class LawReader(StatuteReader):
    key = "query"

    def asked(self, fetch: Callable, key: str) -> list[tuple]:
        found = laws_of(within(self.timeout, fetch, "laws", {"query": key, "display": self.display}))[: self.display]
        return [(key, i, str(r.get("법령ID", "")), str(r.get("법령명한글", r.get("법령명", "")))) for i, r in enumerate(found)]


class ArticleReader(StatuteReader):
    key = "law_id"

    def asked(self, fetch: Callable, key: str) -> list[tuple]:
        found = articles_of(within(self.timeout, fetch, "articles", {"ID": key}))
        return [(key, i, str(r.get("조번호", "")), str(r.get("조제목", "")), str(r.get("조문내용", ""))) for i, r in enumerate(found)]


class LawSource(DataSource):  # S5
    """``spark.read.format("laws").option("transport", ...).load().where("query IN (...)")``."""

    @classmethod
    def name(cls) -> str:
        return "laws"

    def schema(self) -> str:
        return "query string, ord int, law_id string, law_name string"

    def reader(self, schema) -> DataSourceReader:
        return LawReader(self.options)


class ArticleSource(DataSource):  # S6
    """``spark.read.format("articles").option("transport", ...).load().where("law_id IN (...)")``."""

    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return "law_id string, ord int, no string, title string, content string"

    def reader(self, schema) -> DataSourceReader:
        return ArticleReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ImageWriter(DataSourceWriter):  # S13
    """A file a request: written beside its place under a name of the attempt, then renamed."""

    def __init__(self, path: str, suffix: str) -> None:
        self.path, self.suffix = path, suffix

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, root = FileSystem.from_uri(self.path)
        attempt = f"{root}/_attempts/{uuid.uuid4().hex}"
        system.create_dir(attempt, recursive=True)
        names = []
        for r in rows:
            name = quote(str(r["request_id"]), safe="") + self.suffix
            with system.open_output_stream(f"{attempt}/{name}") as out:
                out.write(bytes(r["image"]))
            system.move(f"{attempt}/{name}", f"{root}/{name}")
            names.append(name)
        system.delete_dir(attempt)
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = FileSystem.from_uri(self.path)
        if system.get_file_info(f"{root}/_attempts").type.name == "Directory":
            system.delete_dir(f"{root}/_attempts")  # what attempts that failed have left
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = FileSystem.from_uri(self.path)
        if system.get_file_info(f"{root}/_attempts").type.name == "Directory":
            system.delete_dir(f"{root}/_attempts")


class ImageSink(DataSource):  # S13
    """``images(...).write.format("images").option("path", uri).mode("append").save()``: request_id and image to files.

    Tasks that are tried again write the same names, so that each request has one file and
    no reader sees half of one. ``path`` is a URI of a file system that pyarrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "images"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ImageWriter(self.options["path"], self.options.get("suffix", ".png"))


def laws_of(body: str) -> list[dict]:  # S5
    inner = json.loads(body).get("LawSearch", {})
    return as_list(inner.get("law", []))


def articles_of(body: str) -> list[dict]:  # S6
    inner = json.loads(body).get("법령", {}).get("조문", {})
    return as_list(inner.get("조문단위", []))


def statutes(queries: DataFrame, transport: str, display: int = 2, timeout: float = STATUTE_TIMEOUT) -> tuple[DataFrame, DataFrame]:  # S5, S6, S9
    """laws (query_id, ord, law_id, law_name) and articles (law_id, ord, no, title, content).

    Each text is looked up once, whoever asks, and each law that is found once: the answers are
    stored, so later stages do not ask again. Failures and late answers are empty results. Each task opens its
    own transport.
    """

    def laws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = call(transport)
        for batch in batches:
            out = []
            for q in batch.column(0).to_pylist():
                try:
                    found = laws_of(within(timeout, fetch, "laws", {"query": q, "display": display}))[:display]
                except Exception:
                    found = []
                out += [(q, i, str(r.get("법령ID", "")), str(r.get("법령명한글", r.get("법령명", "")))) for i, r in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], ["query", "ord", "law_id", "law_name"])

    def articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = call(transport)
        for batch in batches:
            out = []
            for law in batch.column(0).to_pylist():
                try:
                    found = articles_of(within(timeout, fetch, "articles", {"ID": law}))
                except Exception:
                    found = []
                out += [(law, i, str(r.get("조번호", "")), str(r.get("조제목", "")), str(r.get("조문내용", ""))) for i, r in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["law_id", "ord", "no", "title", "content"])

    asked = queries.where("query IS NOT NULL").select("query").distinct()
    found = storage.stored(asked.mapInArrow(laws, "query string, ord int, law_id string, law_name string"))
    ids = found.where("law_id != ''").select("law_id").distinct()
    texts = storage.stored(ids.mapInArrow(articles, "law_id string, ord int, no string, title string, content string"))
    return queries.select("query_id", "query").join(found, "query").select("query_id", "ord", "law_id", "law_name"), texts


def complete(prompts: DataFrame, client: str, retries: int = 2, backoff: float = 1.0, strict: bool = True) -> DataFrame:  # L1, S10, C6
    """question_id, variant_idx, answer; the caller stores the result once, for retried tasks would ask again.

    A prompt that still fails after the retries fails the job, or has a null answer if not ``strict``.

    ``client`` names a factory of callables from a list of messages to a text, made once per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = call(client)()
        for batch in batches:
            out = []
            for m in batch.column(2).to_pylist():
                for attempt in range(retries + 1):
                    try:
                        out.append(ask(m))
                        break
                    except Exception:
                        if attempt == retries:
                            if strict:
                                raise
                            out.append(None)
                            break
                        time.sleep(backoff * 2**attempt)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["question_id", "variant_idx", "answer"])

    rows = prompts.where("messages IS NOT NULL").select("question_id", "variant_idx", "messages")
    return rows.mapInArrow(run, "question_id long, variant_idx int, answer string")


def usable_models(catalogue: DataFrame, method: str = "generateContent") -> DataFrame:  # S14
    return catalogue.where(F.array_contains("methods", method)).select("name", "display_name")


def images(replies: DataFrame) -> DataFrame:  # S13
    """request_id, image (binary) from (request_id, parts: array of text and inline_data).

    The first part with data counts; base64 is decoded, and what is none, or no reply, gives no row.
    Images are keyed by request, so that none overwrites another.
    """
    data = F.get(F.filter("parts", lambda p: F.coalesce(p["inline_data"], F.lit("")) != ""), F.lit(0))["inline_data"]
    return replies.select("request_id", F.try_to_binary(data, F.lit("base64")).alias("image")).where("image IS NOT NULL")


def image_prompts(requests: DataFrame, client: str, systems: tuple[str, str], retries: int = 0, backoff: float = 1.0) -> DataFrame:  # L7
    """question_id, prompt: what a first model says of the text, put to a second one; null if either fails.

    requests: question_id, text.
    """
    message = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    asked = lambda rows, system, x: rows.select(
        "question_id", F.lit(0).alias("variant_idx"), F.when(x.isNotNull(), F.array(message("system", F.lit(system)), message("user", x))).alias("messages")
    )
    first = complete(asked(requests, systems[0], F.col("text")), client, retries, backoff, strict=False)
    second = complete(asked(first, systems[1], F.col("answer")), client, retries, backoff, strict=False)
    return requests.select("question_id").join(second.select("question_id", F.col("answer").alias("prompt")), "question_id", "left")

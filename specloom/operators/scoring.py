"""Model-backed steps behind a small protocol: requests are built and batched by Spark, answered by a Scorer, parsed by Spark."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import EXTRACTION, decode
from .common import held, numbered
from .packages import only_drawings
from .summaries import pages_to_read

# Limits of a batch and of a request's context.
MAX_REQUESTS, SAFE_BYTES, HARD_BYTES = 10_000, 220 * 1024 * 1024, 256 * 1024 * 1024
CONTEXT_TOKENS, CONTEXT_SHARE = 200_000, 0.9


class Scorer(Protocol):
    """Answers prompts in order, each with JSON text, or raises; built once in each task from its factory."""

    def answer(self, prompts: list[str]) -> list[str]: ...


class FixedScorer:
    """A deterministic stand-in: the same JSON for every prompt, or what a rule says."""

    def __init__(self, rule: Callable[[str], dict] | dict):
        self.rule = rule

    def answer(self, prompts: list[str]) -> list[str]:
        return [json.dumps(self.rule(p) if callable(self.rule) else self.rule) for p in prompts]


def ask(requests: DataFrame, make_scorer: Callable[[], Scorer], prompt: str = "prompt", size: int = 64) -> DataFrame:
    """requests with type ('succeeded' or 'errored'), response and error. A failing call fails its own requests only."""
    at = requests.columns.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer()
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                batch = whole.slice(start, size)
                prompts = batch.column(at).to_pylist()
                try:
                    answers, error = scorer.answer(prompts), None
                except Exception as e:  # noqa: BLE001
                    answers, error = [None] * len(prompts), str(e)
                kinds = ["errored" if a is None else "succeeded" for a in answers]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds), pa.array(answers, pa.string()), pa.array([error if a is None else None for a in answers], pa.string())], names=[*batch.schema.names, "type", "response", "error"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields]
    return requests.mapInArrow(run, ", ".join([*fields, "type string", "response string", "error string"]))


def run_requests(runs: DataFrame, template: str) -> DataFrame:
    """A request for each run (spec_id, division, section_number, start, end): id, page keys and prompt."""
    c = F.col
    pages = T.page_range(c("start"), c("end"))
    return runs.select(
        "*",
        T.composite_id(c("division"), c("section_number"), c("spec_id"), c("start"), c("end")).alias("custom_id"),
        F.transform(pages, lambda p: T.page_key(c("spec_id"), p)).alias("page_keys"),
        T.prompt(template, section_number=c("section_number"), pages_analyzed=F.to_json(pages)).alias("prompt"),
    )


def section_requests(runs: DataFrame, pages: DataFrame, template: str) -> DataFrame:
    """A request for each section's runs (spec_id, section_number, start, end) that carries the texts of its pages, in order, without blank ones."""
    c = F.col
    wanted = runs.select("spec_id", "section_number", F.explode(T.page_range(c("start"), c("end"))).alias("page_index")).distinct()
    texts = wanted.join(pages.where(T.has_text(c("text"))).select("spec_id", "page_index", "text"), ["spec_id", "page_index"])
    lists = texts.groupBy("spec_id", "section_number").agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("_p"))
    return lists.select("spec_id", "section_number", F.transform("_p", lambda p: p["page_index"]).alias("pages"), T.prompt(template, section_number=c("section_number"), pages=T.page_blocks(c("_p"))).alias("prompt"))


def extractions(answers: DataFrame, response: str = "response") -> DataFrame:
    """Answers of the extraction step as records; what cannot be read is kept in `raw`."""
    return decode(answers, response, EXTRACTION)


def choose_template(drawings_only, general: str, drawings: str):
    """The prompt for a package that holds shop drawings alone, or the general one."""
    return F.when(drawings_only, drawings).otherwise(general)


def batches(requests: DataFrame, size: str = "size_bytes", order: str = "seq", span: int = 100_000, most_requests: int = MAX_REQUESTS, most_bytes: int = SAFE_BYTES) -> DataFrame:
    """requests with batch: no batch has more than most_requests or, unless one request does alone, most_bytes.

    Running sums within each `span` of the order cut the batches, so there are as many tasks as there are spans. A batch
    is closed by half its allowance crossed, so a request never straddles the limit; one of more than half stands alone."""
    dealt = requests.withColumn("_g", F.expr(f"{order} div {span}"))
    w = Window.partitionBy("_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = dealt.withColumn("_bytes", F.sum(size).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    alone = F.col(size) > most_bytes // 2
    shared = F.concat_ws("-", "_g", F.expr(f"(_bytes - {size}) div {most_bytes // 2}"), F.expr(f"(_n - 1) div {most_requests}"))
    return numbered.withColumn("batch", F.when(alone, F.concat(F.lit("alone-"), F.col(order).cast("string"))).otherwise(shared)).drop("_g", "_bytes", "_n")


def _next_starts(sizes: np.ndarray, most_requests: int, most_bytes: int) -> np.ndarray:
    """For a batch that begins at each request, where the next one begins."""
    upto, at = np.concatenate([[0], np.cumsum(sizes)]), np.arange(len(sizes))
    full = np.searchsorted(upto, upto[:-1] + most_bytes, side="right") - 1
    return np.maximum(at + 1, np.minimum(at + most_requests, full))


def full_batches(requests: DataFrame, size: str = "size_bytes", order: str = "seq", span: int = 1_000_000, most_requests: int = MAX_REQUESTS, most_bytes: int = SAFE_BYTES) -> DataFrame:
    """requests with batch, the position of its first request: a batch takes requests in order until the next one would
    exceed most_requests or most_bytes (a larger request stands alone), exactly as one pass over all of them would.

    Spans of requests are looked at in parallel: for each place at which a batch may first begin in a span, where the first one
    begins in the span after. These maps are composed by doubling the distance, which gives the true beginning in every
    span; then each span cuts its batches. A task sees a span and the most_requests requests after it."""
    if span < most_requests:
        raise ValueError("a span must be able to hold a batch")
    rows = numbered(requests, [order, size])
    spans = rows.select(F.expr(f"_pos div {span}").alias("_s"), "_pos", F.col(size).cast("bigint").alias("_size"))
    after = spans.where(f"_s > 0 and _pos % {span} < {most_requests}").withColumn("_s", F.col("_s") - 1)
    seen = spans.unionByName(after)
    count = rows.count()
    last = (count - 1) // span

    def starts(frame: pd.DataFrame) -> tuple[pd.DataFrame, int, np.ndarray]:
        frame = frame.sort_values("_pos")
        own = int((frame["_pos"] // span == frame["_s"].iloc[0]).sum())
        return frame, own, _next_starts(frame["_size"].to_numpy(), most_requests, most_bytes)

    def leap(frame: pd.DataFrame) -> pd.DataFrame:
        frame, own, following = starts(frame)
        out = following.tolist()
        for i in range(own - 1, -1, -1):
            if out[i] < own:
                out[i] = out[out[i]]
        n = min(own, most_requests)
        return pd.DataFrame({"_s": frame["_s"].iloc[0], "entry": np.arange(n), "leave": np.array(out[:n], np.int64) - own})

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame, own, following = starts(frame)
        at, batch, positions = int(frame["entry"].iloc[0]), np.full(len(frame), -1), frame["_pos"].to_numpy()
        while at < own:
            batch[at : following[at]] = positions[at]
            at = int(following[at])
        return pd.DataFrame({"_pos": positions, "batch": batch})[batch >= 0]

    entries = requests.sparkSession.createDataFrame([(0, 0)], "_s bigint, entry bigint")
    if last > 0:
        leaps = [held(seen.groupBy("_s").applyInPandas(leap, "_s bigint, entry bigint, leave bigint"))]
        while 2 ** len(leaps) <= last:
            far = leaps[-1].select((F.col("_s") - 2 ** (len(leaps) - 1)).alias("_s"), F.col("entry").alias("leave"), F.col("leave").alias("_far"))
            leaps.append(held(leaps[-1].join(far, ["_s", "leave"]).select("_s", "entry", F.col("_far").alias("leave"))))
        for k in reversed(range(len(leaps))):
            further = entries.join(leaps[k], ["_s", "entry"]).select((F.col("_s") + 2**k).alias("_s"), F.col("leave").alias("entry")).where(F.col("_s") <= last)
            entries = held(entries.unionByName(further))
    dealt = seen.join(entries, "_s").groupBy("_s").applyInPandas(deal, "_pos bigint, batch bigint")
    return rows.join(dealt, "_pos").drop("_pos")


def batch_metrics(batched: DataFrame, size: str = "size_bytes") -> DataFrame:
    """Per batch: requests, bytes, status (ok, warning, error) and headroom to the hard limit."""
    out = batched.groupBy("batch").agg(F.count(F.lit(1)).alias("request_count"), F.sum(size).alias("size_bytes"))
    status = F.when((F.col("request_count") > MAX_REQUESTS) | (F.col("size_bytes") >= HARD_BYTES), "error").when(F.col("size_bytes") >= SAFE_BYTES, "warning").otherwise("ok")
    return out.withColumns({"size_mb": F.round(F.col("size_bytes") / (1024 * 1024), 3), "status": status, "headroom_bytes": F.greatest(F.lit(0), F.lit(HARD_BYTES) - F.col("size_bytes"))})


def request_size(request):
    """Bytes of a request as JSON."""
    return F.octet_length(F.to_json(request))


def fits_context(tokens):
    return tokens <= int(CONTEXT_TOKENS * CONTEXT_SHARE)


def within_context(requests: DataFrame, estimate: str, count_exactly: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """requests with tokens and fits. An estimate below half of the allowance is taken as it is; only the others are counted
    (count_exactly adds `exact_tokens`, null where it failed, and a request that cannot be counted does not fit)."""
    small = F.coalesce(F.col(estimate) < CONTEXT_TOKENS * CONTEXT_SHARE * 0.5, F.lit(False))
    sure = requests.where(small).withColumn("tokens", F.col(estimate).cast("bigint")).withColumn("fits", F.lit(True))
    counted = count_exactly(requests.where(~small)).withColumn("tokens", F.col("exact_tokens").cast("bigint"))
    return sure.unionByName(counted.withColumn("fits", F.coalesce(fits_context(F.col("tokens")), F.lit(False))).drop("exact_tokens"))


def package_check_requests(packages: DataFrame, sections: DataFrame, submittals: DataFrame, general: str, drawings: str, url_prefix: str = "") -> DataFrame:
    """A request for each package (id, spec_id, section_number) that has submittals: prompt, whether it holds shop drawings alone, and blocks.

    Blocks are the section's pages (primary ones, else reference ones, in ascending runs), the last of them marked for the
    cache, then the submittals by id, each part after a line of text. A package whose section does not exist gets `error`."""
    pages = pages_to_read(F.col("primary_pages"), F.col("reference_pages"))
    own = sections.select("spec_id", "section_number", F.array_sort(F.array_distinct(pages)).alias("_pages"), F.lit(True).alias("_found"))
    docs = submittals.groupBy(F.col("package_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "s3_key"))), lambda s: s["s3_key"]).alias("_keys"))
    rows = packages.join(docs, "id").join(only_drawings(submittals.withColumnRenamed("package_id", "_package"), ["_package"]).withColumnRenamed("_package", "id"), "id").join(own, ["spec_id", "section_number"], "left")

    def block(kind, text=None, url=None, cached=None):
        none = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("type"), (none if text is None else text).alias("text"), (none if url is None else url).alias("url"), (F.lit(False) if cached is None else cached).alias("cached"))

    last = F.element_at("_pages", -1)
    of_pages = F.transform("_pages", lambda p: block("document", url=F.concat(F.lit(url_prefix), T.page_key(F.col("spec_id"), p)), cached=p == last))
    of_docs = F.transform("_keys", lambda k: block("document", url=F.concat(F.lit(url_prefix), k)))
    first = F.concat(F.lit("The following are the specification section "), "section_number", F.lit(" pages:"))
    blocks = F.concat(F.array(block("text", text=first)), of_pages, F.array(block("text", text=F.lit("The following are the submittal documents to review:"))), of_docs)
    asked = choose_template(F.col("drawings_only"), general, drawings)
    found = F.coalesce(F.col("_found"), F.lit(False))
    return rows.select(
        *packages.columns,
        "drawings_only",
        F.when(found, F.replace(asked, F.lit("{section_number}"), F.col("section_number"))).alias("prompt"),
        F.when(found, blocks).alias("blocks"),
        F.when(~found, "section not found").alias("error"),
    )


def total_tokens(usage):
    """Input and output tokens of an answer."""
    return F.coalesce(usage["input_tokens"], F.lit(0)) + F.coalesce(usage["output_tokens"], F.lit(0))


def closed_schema(schema):
    """A JSON schema in which every object, at any depth, takes no further properties. Driver-side."""
    if isinstance(schema, list):
        return [closed_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: closed_schema(v) if k not in ("enum", "const", "default", "examples") else v for k, v in schema.items()}
    return {**out, "additionalProperties": out.get("additionalProperties", False)} if schema.get("type") == "object" else out

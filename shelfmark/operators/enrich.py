"""Metadata enrichment: prompts, user-supplied models, parsed replies, cluster names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .. import constants as K
from ..functions import replies
from ..functions.text import as_col, blank_to_null, py_strip

PROMPT = """Classify one file. Answer with a single JSON object and nothing else:
{"topic": 2-4 words fit for a folder name, "summary": one sentence,
 "keywords": list of 3-5 strings, "confidence": number from 0 to 1,
 "file_date": "YYYY-MM-DD" if the content names a date, else null}

Name: %s
Type: %s
Content:
%s
"""

NAMING_PROMPT = """Give one folder name of 2-4 words in Title Case that covers all these topics:
%s
Answer with the name alone.
"""


def metadata_prompt(df: DataFrame, max_chars: int = K.PROMPT_CHARS) -> DataFrame:
    """Add ``prompt``; null where the content is blank (such files get the default metadata)."""
    head, name_end, type_end, tail = PROMPT.split("%s")
    prompt = F.concat(F.lit(head), F.col("name"), F.lit(name_end), F.col("category"), F.lit(type_end),
                      F.left("text", F.lit(max_chars)), F.lit(tail))
    return df.withColumn("prompt", F.when(py_strip(F.coalesce("text", F.lit(""))) != "", prompt))


def _answered(fn: Callable[[list], list], values: list, default, kind: pa.DataType) -> tuple[list, list]:
    """Answers and errors, one of each per value. A list that fails is halved, so only rows that fail alone do.

    An answer that is not of ``kind`` is a failure as well.
    """
    try:
        got = list(fn(values))
        if len(got) != len(values):
            raise ValueError(f"{len(got)} answers for {len(values)} inputs")
        pa.array(got, kind)
        return got, [None] * len(values)
    except Exception as error:
        if len(values) == 1:
            return [default], [f"{type(error).__name__}: {error}"]
    half = len(values) // 2
    first, second = (_answered(fn, part, default, kind) for part in (values[:half], values[half:]))
    return first[0] + second[0], first[1] + second[1]


def score_batches(df: DataFrame, make_fn: Callable[[], Callable[[list], list]], in_col: str,
                  out_col: str, returns: str | DataType = "string", batch: int = K.MODEL_BATCH,
                  default=None, error_col: str | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """Add ``out_col``: a model's answer for ``in_col``, and its error as ``error_col`` if that is named.

    ``make_fn`` loads the model once per task and returns ``list -> list``. A batch that fails is
    halved until the rows that fail are alone. Such a row gets ``default`` and its error; a null
    input gets ``default`` and no error. ``profile`` sets what a task of this stage needs (an
    accelerator, say), so that a cluster runs as many models at once as it has of those; all
    columns travel to Python then, without it only the input column does.
    """
    def scored(values: list, fn) -> tuple[list, list]:
        given = [i for i, v in enumerate(values) if v is not None]
        answers, errors = [default] * len(values), [None] * len(values)
        for start in range(0, len(given), batch):
            places = given[start:start + batch]
            for place, answer, error in zip(places, *_answered(fn, [values[i] for i in places], default, answer_type)):
                answers[place], errors[place] = answer, error
        return answers, errors

    kind = T.StructType.fromDDL(f"a {returns}")["a"].dataType if isinstance(returns, str) else returns
    reply = T.StructType([T.StructField("answer", kind), T.StructField("error", T.StringType())])
    answer_type = to_arrow_type(kind)

    def columns(values: pa.Array, fn) -> list[pa.Array]:
        answers, errors = scored(values.to_pylist(), fn)
        return [pa.array(answers, answer_type), pa.array(errors, pa.string())]

    @F.arrow_udf(reply)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make_fn()
        for values in batches:
            yield pa.StructArray.from_arrays(columns(values, fn), names=["answer", "error"])

    def score_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make_fn()
        for rows in batches:
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns(rows.column("_input"), fn)],
                                             names=[*rows.schema.names, "_answer", "_error"])

    if profile is None:
        held = df.withColumn("_reply", score(F.col(in_col)))
        out = held.withColumn(out_col, F.col("_reply.answer"))
        return (out if error_col is None else out.withColumn(error_col, F.col("_reply.error"))).drop("_reply")
    asked = df.withColumn("_input", F.col(in_col))
    schema = T.StructType([*asked.schema.fields, T.StructField("_answer", kind), T.StructField("_error", T.StringType())])
    out = asked.mapInArrow(score_rows, schema, profile=profile).withColumn(out_col, F.col("_answer"))
    return (out if error_col is None else out.withColumn(error_col, F.col("_error"))).drop("_input", "_answer", "_error")


def model_report(scored: DataFrame, error_col: str = "error", by: list[str] | None = None) -> DataFrame:
    """(rows, failed, failure) by the columns ``by``: how many rows failed, and the smallest of their errors."""
    return scored.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.count(error_col).alias("failed"),
                                           F.min(error_col).alias("failure"))


def enrich(df: DataFrame, reply_col: str = "reply", out: str = "metadata") -> DataFrame:
    """Parse and validate a reply column; whatever fails becomes the default metadata."""
    parsed = df.withColumn("_json", replies.extract_json(py_strip(reply_col)))
    return parsed.withColumn(out, F.coalesce(
        replies.validate_metadata("_json").cast(replies.METADATA_TYPE),
        replies.default_metadata())).drop("_json")


def cluster_topics(df: DataFrame, max_topics: int = K.NAMING_TOPICS) -> DataFrame:
    """(cluster, seq, topic) -> ``topics`` per cluster: the first distinct ones, comma-joined.

    Topics are reduced to their first place before they move, and the rank filter is applied
    on the map side as well, so a cluster never gathers more than a few rows per task.
    """
    topic = F.when(blank_to_null("topic").isNotNull(), F.col("topic"))
    firsts = df.groupBy("cluster", topic.alias("topic")).agg(F.min("seq").alias("first"))
    by_first = Window.partitionBy("cluster").orderBy(F.col("topic").isNull(), "first", "topic")
    ranked = firsts.withColumn("_rank", F.row_number().over(by_first)).filter(F.col("_rank") <= max_topics)
    listed = F.sort_array(F.collect_list(F.when(F.col("topic").isNotNull(), F.struct("_rank", "topic"))))
    joined = F.array_join(F.transform(listed, lambda t: t["topic"]), ", ")
    return ranked.groupBy("cluster").agg(blank_to_null(joined).alias("topics"))


def naming_prompt(df: DataFrame) -> DataFrame:
    """One naming prompt per cluster; null for clusters without topics (named Miscellaneous)."""
    head, tail = NAMING_PROMPT.split("%s")
    return cluster_topics(df).withColumn("prompt", F.concat(F.lit(head), F.col("topics"), F.lit(tail)))


def with_cluster_name(df: DataFrame, reply_col: str = "reply", out: str = "cluster_name") -> DataFrame:
    return df.withColumn(out, replies.cluster_name(as_col(reply_col)))


def attach_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """Replace ``cluster`` by its name from ``names`` (cluster, cluster_name), or keep the label.

    No broadcast is forced: the number of clusters depends on the data, Spark checks the size.
    """
    return (df.join(names.select("cluster", "cluster_name"), "cluster", "left")
            .withColumn("cluster_label", F.coalesce("cluster_name", "cluster"))
            .drop("cluster_name"))

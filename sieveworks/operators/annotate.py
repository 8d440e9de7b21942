"""Structured annotations: request text, response parsing and validation.

No network: annotations come from a table of stored responses (joined by
key) or from a user's function, called once a row. Parsing and validation are
native JSON functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rtrim_ws

# --- fixed values that must equal the reference -----------------------------
CATEGORIES = ["blog", "research", "news", "tutorial", "opinion", "other"]
REQUIRED_KEYS = ["summary", "takeaways", "category", "relevance_score", "tags"]
TRUNCATION_MARKER = "\n\n[…content truncated for length]"
DEFAULT_MAX_CONTENT_CHARS = 6000
OVERVIEW_MAX_ITEMS = 20
# -----------------------------------------------------------------------------

ANNOTATION_SCHEMA = ("struct<summary: string, takeaways: array<string>, category: string, "
                     "relevance_score: double, tags: array<string>>")


def truncate_content(content, max_chars: int = DEFAULT_MAX_CONTENT_CHARS) -> F.Column:
    c = F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit(""))
    if not max_chars:
        return c
    return F.when(F.length(c) > max_chars,
                  F.concat(rtrim_ws(F.substring(c, 1, max_chars)), F.lit(TRUNCATION_MARKER))).otherwise(c)


def request_text(df: DataFrame, max_chars: int = DEFAULT_MAX_CONTENT_CHARS, none_as_text: bool = False) -> F.Column:
    """Title / Source / Author / Published / Content lines."""
    def v(c):
        return F.coalesce(F.col(c), F.lit("None" if none_as_text else ""))
    return F.concat(F.lit("Title: "), v("title"), F.lit("\nSource: "), v("source_url"),
                    F.lit("\nAuthor: "), v("author"), F.lit("\nPublished: "), v("published_at"),
                    F.lit("\nContent:\n"), truncate_content("content", max_chars))


def parse_response(resp) -> F.Column:
    """Valid JSON -> struct (takeaways null -> [], score as double); invalid
    JSON -> (null, [], 'other', 0.0, [])."""
    r = F.col(resp) if isinstance(resp, str) else resp
    parsed = F.from_json(r, ANNOTATION_SCHEMA)
    valid = F.try_parse_json(r).isNotNull()
    fallback = F.struct(F.lit(None).cast("string").alias("summary"), F.array().cast("array<string>").alias("takeaways"),
                        F.lit("other").alias("category"), F.lit(0.0).alias("relevance_score"),
                        F.array().cast("array<string>").alias("tags"))
    ok = F.struct(parsed["summary"].alias("summary"),
                  F.coalesce(parsed["takeaways"], F.array().cast("array<string>")).alias("takeaways"),
                  F.coalesce(parsed["category"], F.lit("other")).alias("category"),
                  F.coalesce(parsed["relevance_score"], F.lit(0.0)).alias("relevance_score"),
                  F.coalesce(parsed["tags"], F.array().cast("array<string>")).alias("tags"))
    return F.when(valid, ok).otherwise(fallback)


def is_valid_response(resp) -> F.Column:
    """All five keys present, no others, category in the enum, types right."""
    r = F.col(resp) if isinstance(resp, str) else resp
    keys = F.array_sort(F.json_object_keys(r))
    parsed = F.from_json(r, ANNOTATION_SCHEMA)
    return (F.coalesce(keys == F.array(*[F.lit(k) for k in sorted(REQUIRED_KEYS)]), F.lit(False))
            & F.coalesce(parsed["category"].isin(*CATEGORIES), F.lit(False))
            & parsed["summary"].isNotNull() & parsed["takeaways"].isNotNull()
            & parsed["relevance_score"].isNotNull() & parsed["tags"].isNotNull())


def annotate_stored(records: DataFrame, responses: DataFrame, key: str, resp: str = "response") -> DataFrame:
    """Join stored responses by key and attach the parsed annotation. Rows
    without a response are dropped (a failed annotation), but callers keep
    them registered for dedup — dedup runs before this step."""
    j = records.join(responses.select(key, resp), key, "inner")
    return j.withColumn("_a", parse_response(resp)).select(
        *[c for c in records.columns if c not in ("summary",)],
        F.col("_a.summary").alias("summary"), F.col("_a.takeaways").alias("takeaways"),
        F.col("_a.category").alias("category"), F.col("_a.relevance_score").alias("relevance_score"),
        F.col("_a.tags").alias("tags"))


#: A user's function of a request text, or null for no answer; made once a task, so that it can open a client there.
Answer = Callable[[str], str | None]


def ask(text, make: Callable[[], Answer]) -> F.Column:
    """struct(answer, error): the user's function called once for each row's text, its failures kept to their rows.

    A function that raises gives a null answer and the exception as error, as
    does one that gives something other than text; the task goes on. A null
    text is not asked: both are null. Only the text goes to Python, in Arrow
    batches. The function may cost money or answer differently each time, so
    Spark must not call it twice: cut the lineage before reading the result
    more than once.
    """
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fn = make()
        for texts in batches:
            rows = [_answer(fn, t) for t in texts]
            yield pd.DataFrame({"answer": pd.Series([a for a, _ in rows], dtype=object), "error": pd.Series([e for _, e in rows], dtype=object)})
    answers.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(answers, "answer string, error string").asNondeterministic()(text)


def _answer(fn: Answer, text: str | None) -> tuple[str | None, str | None]:
    if text is None:
        return None, None
    try:
        got = fn(text)
    except Exception as e:  # noqa: BLE001 - whatever a user's function raises is that row's failure
        return None, f"{type(e).__name__}: {e}"
    if got is None or isinstance(got, str):
        return got, None
    return None, f"TypeError: the answer is {type(got).__name__}, not text"


def annotate_with(records: DataFrame, make: Callable[[], Answer], max_chars: int = DEFAULT_MAX_CONTENT_CHARS) -> DataFrame:
    """``records`` with the annotation that the user's function answers to their request texts, and ``annotation_error``.

    The answer is parsed as a stored response is (invalid JSON takes the
    fallback, it is no failure). A row whose function raised has a null
    annotation and the reason in ``annotation_error``; rows without an answer
    get the reason ``no answer``. ``annotated`` leaves these rows out; dedup
    runs before, so they still block their duplicates.
    """
    fields = ["summary", "takeaways", "category", "relevance_score", "tags"]
    asked = records.withColumn("_asked", ask(request_text(records, max_chars), make))
    error = F.coalesce(F.col("_asked.error"), F.when(F.col("_asked.answer").isNull(), F.lit("no answer")))
    parsed = asked.withColumn("annotation_error", error).withColumn("_a", F.when(error.isNull(), parse_response(F.col("_asked.answer"))))
    return parsed.select(*[c for c in records.columns if c not in (*fields, "annotation_error")], *[F.col(f"_a.{f}").alias(f) for f in fields], "annotation_error")


def annotated(records: DataFrame) -> DataFrame:
    """The rows whose annotation did not fail (all, if none was asked for)."""
    return records.where("annotation_error is null") if "annotation_error" in records.columns else records

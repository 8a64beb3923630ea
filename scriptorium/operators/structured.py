"""Model output as typed rows: parsing under a schema, checks, repairs of failing rows, failures as rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import kept

#: The shapes that generators of questions and cards return.
STEM = "question string, explanation string"
CARDS = "cards array<struct<front:string,back:string>>"

_CORRUPT = "_corrupt_record"
_FAULT = "struct<check:string,detail:string>"


def _misses(value: Column, kind: T.DataType) -> Column:
    """Whether a value, or one inside it, is null."""
    if isinstance(kind, T.StructType):
        inner = [_misses(value[f.name], f.dataType) for f in kind]
        return value.isNull() | _any(inner)
    if isinstance(kind, T.ArrayType):
        return value.isNull() | F.coalesce(F.exists(value, lambda x: _misses(x, kind.elementType)), F.lit(False))
    return value.isNull()


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def parsed(answers: DataFrame, schema: str, checks: Mapping[str, Callable[[Column], Column]] | None = None, optional: Sequence[str] = (), column: str = "raw") -> DataFrame:
    """`answers` with `value`, the struct of `schema` in the text `column`, and `faults` (array of check, detail), empty if all is well.

    A text may stand in a code fence. Faults: no_answer for a null or blank text,
    malformed for one that is no JSON of this schema, missing for a field that is null or
    has a null inside, unless it is `optional`, and the names of `checks` that a whole
    value does not pass. Fields beyond the schema are ignored. `value` is null with a fault.
    """
    kind = T.StructType.fromDDL(schema)
    bare = F.regexp_replace(F.trim(F.col(column)), r"^```[a-z]*\s*|\s*```$", "")
    read = F.from_json(bare, T.StructType([*kind.fields, T.StructField(_CORRUPT, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = answers.withColumn("_read", read)
    got = F.col("_read")
    fault = lambda name, detail, bad: F.when(bad, F.struct(F.lit(name).alias("check"), detail.cast("string").alias("detail")))
    silent = F.coalesce(F.trim(F.col(column)), F.lit("")) == ""
    broken = got.isNull() | got[_CORRUPT].isNotNull()
    holes = [fault("missing", F.lit(f.name), _misses(got[f.name], f.dataType)) for f in kind if f.name not in optional]
    value = F.struct(*[got[f.name].alias(f.name) for f in kind])
    # A check sees whole values only, so it need not think of nulls.
    failed = [fault(name, F.to_json(value), ~F.coalesce(test(got), F.lit(False))) for name, test in (checks or {}).items()]
    some = lambda tests: F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast(f"array<{_FAULT}>")
    missing = some(holes)
    faults = (
        F.when(silent, F.array(fault("no_answer", F.lit(""), F.lit(True))))
        .when(broken, F.array(fault("malformed", F.left(F.col(column), F.lit(200)), F.lit(True))))
        .when(F.size(missing) > 0, missing)
        .otherwise(some(failed))
    )
    out = rows.withColumn("faults", faults.cast(f"array<{_FAULT}>"))
    return out.withColumn("value", F.when(F.size("faults") == 0, value)).drop("_read")


def repair_prompt(prompt: Column, faults: Column) -> Column:
    """The prompt again, with what was wrong with the last answer."""
    said = F.array_join(F.transform(faults, lambda x: F.concat_ws(": ", x["check"], x["detail"])), "; ")
    return F.concat(prompt, F.lit("\n\nThe last answer was not accepted ("), said, F.lit("). Answer with JSON of the schema alone."))


def generated(prompts: DataFrame, generator, schema: str, checks: Mapping[str, Callable[[Column], Column]] | None = None, attempts: int = 2, optional: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(good: the columns of `prompts`, value, attempt; failures: the columns of `prompts`, attempt, check, detail, final).

    `generator.generate` adds `raw` to prompts (prompt, ...). Only rows with faults are
    asked again, told what was wrong, `attempts` times in all. Every fault of every
    attempt is a row of failures; `final` marks those of rows that never passed.
    """
    own = prompts.columns
    first = prompts.withColumn("_asked", F.col("prompt"))
    good = failures = None
    for attempt in range(1, attempts + 1):
        said = generator.generate(first).withColumn("attempt", F.lit(attempt))
        # Written, so that no model is asked twice for one row.
        checked = kept(parsed(said, schema, checks, optional).withColumn("prompt", F.col("_asked")))
        passed = checked.filter(F.size("faults") == 0).select(*own, "value", "attempt")
        bad = checked.filter(F.size("faults") > 0)
        last = attempt == attempts
        rows = bad.select(*own, "attempt", F.inline("faults")).withColumn("final", F.lit(last))
        good = passed if good is None else good.unionByName(passed)
        failures = rows if failures is None else failures.unionByName(rows)
        if last or bad.isEmpty():
            break
        first = bad.select(*own, "_asked", "faults").withColumn("prompt", repair_prompt(F.col("_asked"), F.col("faults"))).drop("faults")
    return good, failures

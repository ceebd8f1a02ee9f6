"""Date, naming, JSON, map and log scalar functions (I12-I24), all native
column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity keywords, checked in this order; first match wins.
SEVERITY_RULES = [
    ("error", ["ERROR", "FAILED", "EXCEPTION"]),
    ("warn", ["WARN", "WARNING"]),
    ("success", ["COMPLETE", "DONE", "SUCCESS", "BEST"]),
    ("info", ["INFO", "[JOB]", "TRIAL", "START"]),
]
# Training-stage keywords (stage index, keywords), highest first.
STAGE_RULES = [
    (3, ["REPORT", "__REPORT__"]),
    (2, ["TRIAL", "OPTUNA", "SCORE"]),
    (1, ["PREPROCESSING", "FEATURE", "TRANSFORM"]),
]
STAGE_COMPLETE_KEYWORD = "TRAINING COMPLETE"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def calendar_parts(col) -> dict[str, Column]:
    """Hour, dayofweek (Monday = 0), quarter, month, year, dayofyear,
    dayofmonth, ISO weekofyear."""
    c = _c(col)
    return {"hour": F.hour(c), "dayofweek": F.weekday(c), "quarter": F.quarter(c), "month": F.month(c),
            "year": F.year(c), "dayofyear": F.dayofyear(c), "dayofmonth": F.dayofmonth(c),
            "weekofyear": F.weekofyear(c)}


def to_number(col) -> Column:
    """Numeric coercion, unparsable -> null."""
    return _c(col).cast("string").try_cast("double")


def slugify(col, default: str = "dataset") -> Column:
    """Letters, digits, '-' and '_' kept, everything else -> '_', then
    leading/trailing '_' stripped; empty -> default."""
    t = F.regexp_replace(F.trim(_c(col)), r"[^\p{L}\p{N}_-]", "_")
    t = F.regexp_replace(t, r"^_+|_+$", "")
    return F.when(t == "", F.lit(default)).otherwise(t)


def artifact_name(col) -> Column:
    """Blanks and dashes -> '_', then one pass of '__' -> '_'."""
    t = F.replace(F.replace(_c(col), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    return F.replace(t, F.lit("__"), F.lit("_"))


def ascii_only(col, default: str = "AutoML_Experiment") -> Column:
    """I16: drop non-ASCII characters; empty -> default."""
    t = F.regexp_replace(_c(col), r"[^\x00-\x7F]", "")
    return F.when(t == "", F.lit(default)).otherwise(t)


def parse_trial_label(col) -> dict[str, Column]:
    """I17: '<model> - Trial <n>' -> (model, trial); unparsable -> (whole, null)."""
    parts = F.split(_c(col), " - ", -1)
    num = F.replace(F.get(parts, 1), F.lit("Trial "), F.lit("")).try_cast("int")
    ok = num.isNotNull()
    return {"model": F.when(ok, F.get(parts, 0)).otherwise(_c(col)), "trial": num}


def duration_hms(start, end) -> Column:
    """Whole seconds between two epoch-second columns as HH:MM:SS."""
    secs = F.floor(_c(end) - _c(start)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(secs / 3600).cast("long"),
                           F.floor((secs % 3600) / 60).cast("long"), (secs % 60).cast("long"))


def encode_json(*cols) -> Column:
    """One request row as JSON text."""
    return F.to_json(F.struct(*[_c(c) for c in cols]))


def decode_json_field(col, path: str) -> Column:
    """One field of a JSON text (null when the text is not JSON)."""
    return F.get_json_object(_c(col), path)


def prefix_params(metrics, params, prefix: str = "param_") -> Column:
    """Add each param not already a metric key as ``param_<key>``
    (later entries overwrite equal keys, like a dict update)."""
    # a map of one list is bound to its name once: written out inside a lambda it would be
    # made again for every key
    bound = lambda value, then: F.transform(F.array(value), then)[0]

    def merged(s: Column) -> Column:
        add = F.transform_keys(F.map_filter(s["p"], lambda k, v: ~F.array_contains(F.map_keys(s["m"]), k)),
                               lambda k, v: F.concat(F.lit(prefix), k))
        return bound(F.struct(s["m"].alias("m"), add.alias("add")), lambda t: F.map_concat(
            F.map_filter(t["m"], lambda k, v: ~F.array_contains(F.map_keys(t["add"]), k)), t["add"]))

    return bound(F.struct(_c(metrics).alias("m"), _c(params).alias("p")), merged)


def drop_prefixed_keys(col, prefix: str = "mlflow.") -> Column:
    """Drop map entries whose key starts with ``prefix``."""
    return F.map_filter(_c(col), lambda k, v: ~k.startswith(prefix))


def numeric_entries(col) -> Column:
    """Keep map entries whose value parses as a number."""
    return F.map_filter(_c(col), lambda k, v: v.cast("string").try_cast("double").isNotNull())


def severity(col) -> Column:
    """Log line -> error / warn / success / info / default."""
    u = F.upper(_c(col))
    expr = F.lit("default")
    for label, words in reversed(SEVERITY_RULES):
        cond = None
        for w in words:
            c = u.contains(w)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(label)).otherwise(expr)
    return expr


def stage_from_text(text, status) -> Column:
    """Stage 0-4 from the upper-cased joined last lines and job status;
    -1 when there are no lines."""
    u = F.upper(_c(text))
    expr = F.when(u.isNull() | (u == ""), F.lit(-1)).otherwise(F.lit(0))
    for idx, words in reversed(STAGE_RULES):
        cond = None
        for w in words:
            c = u.contains(w)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(idx)).otherwise(expr)
    return F.when((_c(status) == "completed") | u.contains(STAGE_COMPLETE_KEYWORD), F.lit(4)).otherwise(expr)

"""Value abstraction: numbers become buckets, strings their class and length, structure stays.

Arguments are JSON texts; the result is compact JSON with sorted keys, so that equality is text equality. Null, empty and
flat objects of whole numbers are plain expressions; everything else goes to an Arrow function in batches.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FoldConfig
from .scalar import LONG_MAX, bucket_label

TAG = "_abstract"
#: Flat objects of whole numbers under plain keys.
FLAT = r'^\{\s*"[A-Za-z0-9_]+"\s*:\s*-?(0|[1-9][0-9]{0,17})\s*(,\s*"[A-Za-z0-9_]+"\s*:\s*-?(0|[1-9][0-9]{0,17})\s*)*\}$'


def label_in(bounds: tuple[int, ...], value: int) -> str:
    if value < 0:
        return "-" + label_in(bounds, min(LONG_MAX, -value))
    low = 0
    for bound in bounds:
        if value <= bound:
            return str(bound) if low == bound else f"{low}-{bound}"
        low = min(LONG_MAX, bound + 1)
    return f"{min(LONG_MAX, (bounds[-1] if bounds else 0) + 1)}+"


def _string(s: str) -> dict:
    local, at, domain = s.partition("@")
    if at and local and "." in domain and not domain.startswith("."):
        kind = "email"
    elif re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s):
        kind = "guid"
    else:
        kind = "numeric" if re.fullmatch(r"[0-9]+", s) else "free"
    n = len(s.encode("utf-8", "surrogatepass"))
    size = next((name for most, name in ((0, "0"), (8, "1-8"), (32, "9-32"), (128, "33-128")) if n <= most), "128+")
    return {TAG: "string", "class": kind, "len": size}


def _done(value: dict) -> bool:
    shape = {"numeric": {"bucket"}, "string": {"class", "len"}}.get(value[TAG]) if isinstance(value.get(TAG), str) else None
    return shape is not None and value.keys() == shape | {TAG} and all(isinstance(value[k], str) for k in shape)


def abstract_value(value, config: FoldConfig, bounds: tuple[int, ...] | None = None):
    """The abstraction of a parsed JSON value; bounds of a key hold for all that is under it, until another key has its own."""
    bounds = config.bounds if bounds is None else bounds
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        whole = 0 if value != value else LONG_MAX if value >= LONG_MAX else -LONG_MAX - 1 if value <= -LONG_MAX - 1 else int(value)
        return {TAG: "numeric", "bucket": label_in(bounds, whole)}
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, list):
        return [abstract_value(v, config, bounds) for v in value]
    return value if _done(value) else {k: abstract_value(v, config, config.field_bounds.get(k, bounds)) for k, v in value.items()}


def compact(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def abstract_args(args: Column, config: FoldConfig, nested: bool = True) -> Column:
    """Abstracted canonical JSON of a JSON text; SQL NULL counts as JSON null.

    Without ``nested`` there is no Python in the plan, and a value that is not flat raises.
    """
    keys = F.regexp_extract_all(args, F.lit(r'"([A-Za-z0-9_]+)"'), F.lit(1))
    values = F.regexp_extract_all(args, F.lit(r":\s*(-?[0-9]+)"), F.lit(1))
    plain = args.isNull() | F.trim(args).isin("null", "{}")
    flat = args.rlike(FLAT) & (F.size(F.array_distinct(keys)) == F.size(keys))

    def written(pair: Column) -> Column:
        key, value = pair["k"], pair["v"].cast("bigint")
        label = bucket_label(value, config.bounds)
        for name, bounds in config.field_bounds.items():
            label = F.when(key == name, bucket_label(value, bounds)).otherwise(label)
        return F.concat(F.lit('"'), key, F.lit(f'":{{"{TAG}":"numeric","bucket":"'), label, F.lit('"}'))

    pairs = F.array_sort(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v"))))
    quick = F.when(args.isNull(), "null").when(plain, F.trim(args)).when(flat, F.concat(F.lit("{"), F.array_join(F.transform(pairs, written), ","), F.lit("}")))
    if not nested:
        return F.coalesce(quick, F.raise_error(F.concat(F.lit("not flat: "), args)).cast("string"))

    @F.pandas_udf("string")
    def deep(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else compact(abstract_value(json.loads(t), config)))

    return F.coalesce(quick, deep(F.when(~(plain | flat), args)))

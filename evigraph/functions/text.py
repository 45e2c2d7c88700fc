"""Scalar functions: text normal forms, ids, hashes, scores and small map helpers.

All work on Columns and stay inside Spark's own functions. The one exception is NFKC, which Spark
lacks: ``nfkc`` sends only values with a non-ASCII character through an Arrow function.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# Score words.
SCORE_WORDS = {
    0.9: ["high", "very high", "高", "很高", "重要", "关键", "强"],
    0.6: ["medium", "moderate", "中", "中等", "一般"],
    0.3: ["low", "低", "次要", "弱"],
}
# Texts that refer to an internal id, and how an inference is marked in English and in Chinese.
INTERNAL = r"(?:node|evidence)(?:\s*id)?\s*[:：#]?\s*[a-z0-9][a-z0-9:_-]{7,}|(?:节点|证据)\s*[:：#]?\s*[a-z0-9][a-z0-9:_-]{7,}|(?<![A-Za-z0-9_])[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}(?![A-Za-z0-9_])"
MARKED_EN, MARKED_ZH = r"(?:\[?inference\]?|inferred)\s*:", r"【推断】\s*[:：]?"


def normalise_ws(c: Column) -> Column:
    """White space of any script collapsed to one space and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s﻿]+", " "))


def normalise_ends(c: Column) -> Column:
    """White space of any script off both ends; inside it stays. A text is only searched if its first or last character is such."""
    edges = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.when(edges.rlike(r"(?U)[\s\uFEFF]"), F.regexp_replace(c, r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+\z", "")).otherwise(c)


def decode_entities(c: Column) -> Column:
    """Tab and break tags to white space, other tags dropped, then five entities in order."""
    c = F.regexp_replace(c, r"(?i)<(?:w:)?tab\s*/?>", "\t")
    c = F.regexp_replace(c, r"(?i)<(?:w:)?br\s*/?>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for name, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def nfkc(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with NFKC of ``col`` in ``out``.

    Python sees null for plain ASCII values, so for them it has nothing to do.
    """
    plain = F.col(col).rlike(r"^[\x00-\x7F]*$")
    return df.withColumn(out, F.coalesce(F.when(plain, F.col(col)), _nfkc(F.when(~plain, F.col(col)))))


def entity_key(normal: Column) -> Column:
    """The comparison form of an entity name that is already NFKC."""
    c = F.regexp_replace(normal, "[‐-—]", "-")
    c = F.regexp_replace(c, r"(?U)[\s﻿_-]+", " ")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}\s.+#]", "")
    return F.lower(F.trim(c))


def label_key(normal: Column) -> Column:
    return F.lower(F.trim(normal))


def text_key(normal: Column) -> Column:
    return F.lower(normalise_ws(normal))


def content_hash(c: Column) -> Column:
    """SHA-256 of the base64 form of the UTF-8 bytes."""
    return F.sha2(F.regexp_replace(F.base64(c.cast("binary")), r"\s", "").cast("binary"), 256)


def short_hash(c: Column, n: int) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, n)


def scoped_id(project: Column, kind: str, value: Column, n: int = 16) -> Column:
    """project:kind:hash"""
    return F.concat(project, F.lit(f":{kind}:"), short_hash(value, n))


def stable_block_id(document: Column, content: Column, page: Column, kind: Column, index: Column, text: Column) -> Column:
    return F.concat(document, F.lit(":block:"), short_hash(F.concat_ws("|", content, page.cast("string"), kind, index.cast("string"), text), 20))


def coerce_score(c: Column) -> Column:
    """A number, numeric text or word -> [0, 1]. Blank text is 0, unknown words and NaN .5, null stays null."""
    word = F.lower(F.trim(c))
    number = c.try_cast("double")
    out = F.when(c.isNull(), F.lit(None).cast("double")).when(word == "", 0.0).when(F.isnan(number) | word.rlike(r"^[+-]?inf"), 0.5).when(number.isNotNull(), clamp01(number))
    for score, words in SCORE_WORDS.items():
        out = out.when(word.isin(words), score)
    return out.otherwise(0.5)


def clamp01(c: Column) -> Column:
    """Within [0, 1]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def round4(c: Column) -> Column:
    """Four digits, halves up."""
    return F.floor(c * 10000 + 0.5) / 10000.0


def clip(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def extract_json(c: Column, schema: str) -> Column:
    """The JSON object in a fenced or chatty text, parsed; null if there is none."""
    fence = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fence != "", fence).otherwise(c)
    return F.from_json(F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit("")), schema)


def props_fold(df: DataFrame, keys: list[str], props: str, order: list[Column], last: bool) -> DataFrame:
    """Merge the maps of each group in order: the first (or last) value of a property wins.

    keys + ``props`` (a map; groups without any entry are absent).
    """
    names = [f"__o{i}" for i in range(len(order))]
    rows = df.select(*keys, *[o.alias(n) for o, n in zip(order, names)], F.explode(props).alias("__k", "__v"))
    seq = F.struct(*names)
    pick = F.max_by("__v", seq) if last else F.min_by("__v", seq)
    return rows.groupBy(*keys, "__k").agg(pick.alias("__v")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__v")))).alias(props))


def props_text(c: Column) -> Column:
    """A map as sorted ``key=value`` pairs joined by ``;``."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")


def props_head(c: Column, n: int = 16) -> Column:
    return F.map_from_entries(F.slice(F.array_sort(F.map_entries(c)), 1, n))


def thread_title(c: Column, default: str = "New chat", n: int = 72) -> Column:
    return F.coalesce(F.nullif(F.substring(normalise_ws(c), 1, n), F.lit("")), F.lit(default))


def has_inference_marker(text: Column, lang: Column) -> Column:
    return F.when(F.coalesce(lang == "zh", F.lit(False)), text.rlike(MARKED_ZH)).otherwise(text.rlike("(?iu)" + MARKED_EN))


def refers_internally(text: Column) -> Column:
    """Whether a text has the shape of an internal reference; known ids are looked up by ``operators.analysis.leaking``."""
    return F.coalesce(text.rlike("(?iu)" + INTERNAL), F.lit(False))


def csv_cell(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def highlight_terms(text: Column, query: str) -> Column:
    """Markup escaped, every query token wrapped in <mark>, case ignored."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tokens = [t for t in query.split() if t]
    if not tokens:
        return out
    sign = "".join(f"\\{c}" for c in r".^$*+?()[]{}|\\/-")
    quoted = ["".join(f"\\{c}" if c in sign else c for c in t) for t in tokens]
    return F.regexp_replace(out, f"(?i)({'|'.join(quoted)})", "<mark>$1</mark>")


def sanitize_file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_. -]", "_")


def citation_label(document: Column, page: Column, topic: Column) -> Column:
    """document without extension · page · topic; blanks dropped."""
    name = F.nullif(F.regexp_replace(document, r"(?i)\.(?:pdf|docx)\z", ""), F.lit(""))
    return F.concat_ws(" · ", name, F.concat(F.lit("p. "), page.cast("string")), F.nullif(F.trim(topic), F.lit("")))


def canonical_json(**fields: Column) -> Column:
    """JSON of the fields by name; nulls are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def _canonical(c: Column, kind: DataType) -> Column:
    """``c`` with the keys of structs and maps in order at every level. Null fields and map values are left out, nulls in arrays stay."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*[_canonical(c.getField(f.name), f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _canonical(x, kind.elementType))
    if isinstance(kind, MapType):
        by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        entries = F.array_sort(F.map_entries(F.map_filter(c, lambda _, v: v.isNotNull())), by_key)
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), _canonical(e["value"], kind.valueType).alias("value"))))
    return c


def nested_json(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with the canonical JSON of a struct, map or array in ``out``: equal values have equal texts, however their keys were ordered; null stays null."""
    return df.withColumn(out, F.to_json(_canonical(F.col(col), df.schema[col].dataType)))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    names = df.columns
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").select(*names)

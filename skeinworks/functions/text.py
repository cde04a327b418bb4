"""Text expressions: rendering, cleaning, names, chunks. All but `sentence_chunks` are native Columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPLACEMENT = "�"
MOST_REPLACEMENTS = 5000
MOST_REPLACEMENT_SHARE = 0.25
CHUNK_TOKENS = 4096
HARD_TOKENS = 8192


#: Control characters but tab and line ends, and the code points of all planes that are no characters. What nearly all characters are is
#: looked at first: the class alone would be compared with each in forty steps.
_UNWANTED = "(?![\\x20-\\x{FDCF}])[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FDD0}-\\x{FDEF}" + "".join(f"\\x{{{plane:X}FFFE}}\\x{{{plane:X}FFFF}}" for plane in range(17)).replace("\\x{0FFF", "\\x{FFF") + "]"


def sanitized(text: Column) -> Column:
    """Without control characters (but tab and line ends) and code points that are no characters."""
    return F.regexp_replace(text, _UNWANTED, "")


def sanitized_value(value: Column, kind: T.DataType) -> Column:
    """A value of any type with all strings in it sanitized, at any depth; keys of maps stay."""
    if isinstance(kind, T.StringType):
        return sanitized(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: sanitized_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: sanitized_value(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[sanitized_value(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def sanitized_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f.name: sanitized_value(F.col(f.name), f.dataType) for f in rows.schema.fields})


def readable(text: Column) -> Column:
    """False where decoding left too many replacement characters."""
    n = F.length(text) - F.length(F.replace(text, F.lit(REPLACEMENT), F.lit("")))
    return (n <= MOST_REPLACEMENTS) & ((F.length(text) == 0) | (n <= MOST_REPLACEMENT_SHARE * F.length(text)))


def snippet(text: Column, most: int = 400) -> Column:
    bare = F.trim(text)
    return F.when(F.length(bare) > most, F.concat(F.substring(bare, 1, most - 3), F.lit("..."))).otherwise(bare)


def type_label(name: Column) -> Column:
    """Entity type without its suffix and without what stands before its second capital."""
    bare = F.regexp_replace(name, "Entity$", "")
    return F.regexp_replace(bare, r"^.\P{Lu}*(\p{Lu}.*)$", "$1")


def title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def path(breadcrumbs: Column) -> Column:
    """`Type: Name` of each breadcrumb, joined by arrows."""
    return F.array_join(F.transform(breadcrumbs, lambda b: F.concat(type_label(b["entity_type"]), F.lit(": "), b["name"])), " → ")


def metadata_section(fields: dict[str, Column]) -> Column:
    """Markdown lines of an entity: source, type, name, path and its embeddable fields; empty values are left out."""
    lines = [F.lit("# Metadata"), F.concat(F.lit("**Source**: "), "source_name"), F.concat(F.lit("**Type**: "), type_label(F.col("entity_type"))), F.concat(F.lit("**Name**: "), "name")]
    lines.append(F.when(F.size("breadcrumbs") > 0, F.concat(F.lit("**Path**: "), path(F.col("breadcrumbs")))))
    for name, value in fields.items():
        label = name.replace("_", " ").title()
        lines.append(F.when(F.length(value.cast("string")) > 0, F.concat(F.lit(f"**{label}**: "), value.cast("string"))))
    return F.concat_ws("\n", *lines)


def safe_file_name(name: Column, most: int = 200) -> Column:
    return F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), 1, most)


def shortened_links(text: Column, most: int = 200) -> Column:
    """Markdown without inline image data and over-long links; three or more line ends become two."""
    out = F.regexp_replace(text, r"!\[[^\]]*\]\(data:[^)]*\)", "")
    out = F.regexp_replace(out, rf"\[([^\]]*)\]\((https?://[^)\s]{{{most},}})\)", "$1")
    out = F.regexp_replace(out, rf"https?://\S{{{most},}}", "")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def tokens(text: Column) -> Column:
    """White-space tokens; stands in for a sub-word count where that vocabulary is absent."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def bpe_counts(text: Column, path: str, pattern: str) -> Column:
    """Tokens of each text by a byte-level vocabulary (a file of base64 tokens and ranks), special tokens read as text."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        encoder = _encoder(path, pattern)
        return pa.array([None if t is None else len(encoder.encode_ordinary(t)) for t in (x.as_py() for x in texts)], pa.int64())

    return run(text)


@cache
def _encoder(path: str, pattern: str):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})


_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]|[^.!?\n]+")
_WORD = re.compile("[^\x20\x09-\x0D]+")


def gathered(text: str | None, target: int = CHUNK_TOKENS, most: int = HARD_TOKENS) -> list[str] | None:
    """Sentences (delimiters stay with them) gathered in order until the next would pass `target` tokens; a sentence of more
    than `most` tokens is cut at token borders. Each character is read a fixed number of times."""
    if text is None:
        return None
    out: list[str] = []
    now: list[str] = []
    n = 0
    for sentence in _SENTENCE.findall(text):
        if not sentence.strip(" "):
            continue
        own = sum(1 for _ in _WORD.finditer(sentence))
        if n > 0 and n + own > target:
            out.append("".join(now))
            now, n = [], 0
        if own > most:
            words = _WORD.findall("".join(now) + sentence)
            out += [" ".join(words[i : i + most]) for i in range(0, len(words), most)]
            now, n = [], 0
            continue
        now.append(sentence)
        n += own
    if n > 0:
        out.append("".join(now))
    return out


def sentence_chunks(text: Column, target: int = CHUNK_TOKENS, most: int = HARD_TOKENS) -> Column:
    """Chunks of whole sentences, none over `most` tokens, in Arrow batches: where one ends depends on all before it, which
    built-in functions can only say by copying what they have gathered at each sentence."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([gathered(t.as_py(), target, most) for t in texts], pa.list_(pa.string()))

    return run(text)


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value worked out once, however often fn names it."""
    return F.transform(F.array(value), fn)[0]


def token_slices(text: Column, most: int = HARD_TOKENS) -> Column:
    """A text cut into runs of at most `most` tokens, without overlap."""

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(words) / most).cast("int") - 1, F.lit(0)))
        return F.when(F.coalesce(F.size(words), F.lit(0)) <= 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(words, i * most + 1, most), " ")))

    return bound(tokens(text), cut)


def line_chunks(code: Column, lines: int = 100) -> Column:
    """Code in runs of whole lines."""

    def cut(found: Column) -> Column:
        starts = F.sequence(F.lit(0), F.ceil(F.size(found) / lines).cast("int") - 1)
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i * lines + 1, lines), "\n"))

    return bound(F.split(code, "\n", -1), cut)


def exploded_chunks(rows: DataFrame, chunks: Column) -> DataFrame:
    """One row per chunk, numbered in order; blank chunks are left out after numbering, so gaps stay."""
    out = rows.withColumn("_c", chunks).select("*", F.posexplode("_c").alias("chunk_index", "chunk")).drop("_c")
    out = out.where(F.length(F.trim("chunk")) > 0)
    return out.withColumn("original_entity_id", F.col("entity_id")).withColumn("entity_id", F.concat("entity_id", F.lit("__chunk_"), F.col("chunk_index").cast("string")))


def payload(df: DataFrame, schema_columns: list[str]) -> Column:
    """JSON of the columns that the index has no field for, in the order of their names."""
    rest = sorted(c for c in df.columns if c not in schema_columns)
    return F.to_json(F.struct(*rest)) if rest else F.lit("{}")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text; what is not UTF-8 gives null."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))

"""Scalar column expressions over native JSON (VARIANT) and neutral events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types and the shape of base64 that images may have.
IMAGE_TYPES = ("image/gif", "image/jpeg", "image/png", "image/webp")
BASE64 = r"^[A-Za-z0-9+/]*={0,2}$"
LABEL_LIMIT, PATH_LIMIT = 512, 32_768


def kind_of(x: Column) -> Column:
    """'ARRAY', 'OBJECT' or the type of a scalar; null for null. (schema_of_variant would describe all that is inside.)"""
    is_list, is_map = (F.try_variant_get(x, "$", t).isNotNull() for t in ("array<variant>", "map<string,variant>"))
    return F.when(is_list, "ARRAY").when(is_map, "OBJECT").otherwise(F.schema_of_variant(x))


def vtype(v: Column, path: str) -> Column:
    """The type of the value at path: 'STRING', 'OBJECT', ...; null if there is none."""
    return kind_of(F.try_variant_get(v, path, "variant"))


def _scalar_type(v: Column, path: str) -> Column:
    """The type of a value that is a scalar as a rule."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def vstr(v: Column, path: str) -> Column:
    """The value at path if it is a non-empty string, else null."""
    text = F.try_variant_get(v, path, "string")
    return F.when((_scalar_type(v, path) == "STRING") & (text != ""), text)


def vbool(v: Column, path: str) -> Column:
    """Whether the value at path is true (not merely true-like)."""
    return F.coalesce((_scalar_type(v, path) == "BOOLEAN") & F.try_variant_get(v, path, "boolean"), F.lit(False))


def is_object(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "map<string,variant>").isNotNull()


def is_array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>").isNotNull()


def items(v: Column, path: str) -> Column:
    """The elements of the array at path; none if it isn't one."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def valid_rfc3339(text: Column) -> Column:
    """text if it is a date and time with T and an offset, else null."""
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2}(:\d{2}(\.\d+)?)?)$")
    return F.when(shape & F.try_to_timestamp(F.regexp_replace(text, r",", ".")).isNotNull(), text)


def epoch_ms(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def iso_ms(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def valid_base64(data: Column) -> Column:
    return F.coalesce((data != "") & (F.length(data) % 4 == 0) & data.rlike(BASE64), F.lit(False))


def data_image(url: Column) -> Column:
    """(media_type, data) of a portable data URL, else null."""
    head, data = F.substring_index(url, ",", 1), F.expr("null")
    data = F.when(F.instr(url, ",") > 0, F.substr(url, F.instr(url, ",") + 1))
    media = F.regexp_extract(head, r"^data:(.*);base64$", 1)
    return F.when(url.startswith("data:") & media.isin(*IMAGE_TYPES) & valid_base64(data), F.struct(media.alias("media_type"), data.alias("data")))


def remote_image(url: Column) -> Column:
    """Whether url is an http or https address with a host and without white space."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^\s/?#]+\S*$"), F.lit(False))


def image_from_source(v: Column, path: str) -> Column:
    """The URL form of an image source object ({type: base64, media_type, data} or {type: url, url})."""
    kind, media, data, url = (vstr(v, f"{path}.{n}") for n in ("type", "media_type", "data", "url"))
    inline = F.when(media.isin(*IMAGE_TYPES) & valid_base64(data), F.concat(F.lit("data:"), media, F.lit(";base64,"), data))
    return F.when(kind == "base64", inline).when((kind == "url") & remote_image(url), url)


def content_text(v: Column, path: str) -> Column:
    """A string as it is; of an array the strings and the text fields, without empty ones, joined by line ends."""
    element = lambda x: F.coalesce(F.when(kind_of(x) == "STRING", F.try_variant_get(x, "$", "string")), F.when(vtype(x, "$.text") == "STRING", F.try_variant_get(x, "$.text", "string")))
    parts = F.filter(F.transform(items(v, path), element), lambda t: t.isNotNull() & (t != ""))
    return F.when(vtype(v, path) == "STRING", F.try_variant_get(v, path, "string")).otherwise(F.array_join(parts, "\n"))


def fingerprint_text(text: Column) -> Column:
    """Line ends as LF, and no Unicode white space at either end."""
    lf = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\r", "\n")
    return F.regexp_replace(F.regexp_replace(lf, r"^(?U)[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+$", "")


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys; text that is not JSON stays."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def uuid_text(text: Column) -> Column:
    """The UUID that text is, in lower case, else null."""
    low = F.lower(text)
    return F.when(low.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), low)


def uuid_in(text: Column) -> Column:
    """The last UUID that occurs in a file name, in lower case, else null."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"), 1)
    return F.lower(F.try_element_at(found, F.lit(-1)))


def bounded(text: Column, limit: int = LABEL_LIMIT) -> Column:
    """The first `limit` code points."""
    return F.substring(text, 1, limit)


def stable_uuid(*parts: Column) -> Column:
    """A version 4 shaped UUID derived from the parts, so that a repeated run gives the same ids."""
    h = F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]), 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def claude_dir(cwd: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(cwd, r"[^A-Za-z0-9]", "-"), F.lit("")), F.lit("-"))


def row_shape(kind: Column, text: Column, blocks: Column) -> Column:
    """What may be shown of a row in a report: its kind and lengths, no content."""
    return F.concat(kind, F.lit(":text="), F.coalesce(F.length(text), F.lit(0)).cast("string"), F.lit(":blocks="), F.coalesce(F.size(blocks), F.lit(0)).cast("string"))

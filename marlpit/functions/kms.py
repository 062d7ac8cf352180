"""Columns of a knowledge-base export: the model that a page embeds, and the front matter made of it.

Null pages have no model; missing fields, and explicit nulls, have the defaults below; very long pages are one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
NO_TITLE, NO_AUTHOR, NO_ID, NO_PATH = "제목 없음", "미상", "N/A", "분류 없음"
LEGACY_CODES = ("KEB_KB_SVKNW_COUNSEL", "KEB_KB_SVKNW_ONESTOP")

MODEL = T.StructType(
    [
        T.StructField("gid", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("author", T.StructType([T.StructField("displayName", T.StringType())])),
        T.StructField("lastUpdt", T.LongType()),
        T.StructField("trnsSrc", T.StringType()),
        T.StructField("attachments", T.ArrayType(T.StructType([T.StructField("filename", T.StringType()), T.StructField("id", T.StringType())]))),
        T.StructField("content", T.StringType()),
        T.StructField("folders", T.ArrayType(T.StructType([T.StructField("path", T.ArrayType(T.StringType()))]))),
        T.StructField("folder", T.StructType([T.StructField("path", T.ArrayType(T.StringType()))])),
        T.StructField("_bad", T.StringType()),
    ]
)


def model_json(html: Column) -> Column:
    """The object assigned to ``model``, up to the first ``};``; null where there is none."""
    return F.nullif(F.regexp_extract(html, r"(?s)model = (\{.*?\});", 1), F.lit(""))


def model(html: Column) -> Column:
    """The parsed model; its field _bad holds text that is not valid JSON."""
    return F.from_json(model_json(html), MODEL, {"columnNameOfCorruptRecord": "_bad"})


def service_code(html: Column) -> Column:
    path = F.regexp_replace(F.regexp_extract(html, r'catalog="(/[^"]+)/catalog\.xml\.jsp"', 1), r"^/+|/+$", "")
    return F.coalesce(F.lower(F.try_element_at(F.split(path, "/"), F.lit(2))), F.lit(""))


def display_id(service: Column, gid: Column, id_: Column) -> Column:
    return F.concat_ws("_", F.nullif(service, F.lit("")), gid, F.when(gid != id_, id_))


def updated_at(epoch_ms: Column) -> Column:
    """Local time of the session; ``N/A`` unless positive."""
    return F.when(epoch_ms > 0, F.date_format(F.timestamp_millis(epoch_ms), "yyyy-MM-dd HH:mm:ss")).otherwise(NO_ID)


def legacy(source: Column, codes: tuple[str, ...] = LEGACY_CODES) -> Column:
    return F.coalesce(source.isin(*codes), F.lit(False))


def attachment_list(attachments: Column) -> Column:
    text = lambda c: F.coalesce(c, F.lit("None"))
    return F.transform(F.coalesce(attachments, F.array().cast("array<struct<filename:string,id:string>>")), lambda a: F.concat(text(a["filename"]), F.lit(" (ID: "), text(a["id"]), F.lit(")")))


def folder_path(kind: Column, parsed: Column) -> Column:
    """For type ``kms`` the first of the folders, for others the folder; parts joined by ' > '."""
    path = F.when(kind == "kms", F.get(parsed["folders"], F.lit(0))["path"]).otherwise(parsed["folder"]["path"])
    return F.coalesce(F.nullif(F.array_join(path, " > "), F.lit("")), F.lit(NO_PATH))


def front_matter(shown: Column, title: Column, path: Column, updated: Column, author: Column, is_legacy: Column, attached: Column) -> Column:
    """Six keys, then the attachments if any; inner quotes stay as they are."""
    row = lambda key, value: F.concat(F.lit(f'{key}: "'), value, F.lit('"'))
    fixed = F.array(F.lit("---"), row("지식_ID", shown), row("제목", title), row("분류", path), row("최종수정일", updated), row("작성자", author), F.concat(F.lit("이관자료: "), F.when(is_legacy, "true").otherwise("false")))
    listed = F.when(F.size(attached) > 0, F.concat(F.array(F.lit("첨부파일:")), F.transform(attached, lambda a: F.concat(F.lit(' - "'), a, F.lit('"'))))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(fixed, listed, F.array(F.lit("---"))), "\n")

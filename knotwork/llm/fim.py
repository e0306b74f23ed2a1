"""Fill-in-middle: whole texts are cut into units, rearranged around sentinels and restored from the result, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A unit is a run of ASCII letters or one other code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SENTINEL = "<[PSM]>"
#: Shares, in a hundred, of texts that stay as they are and, of the others, of those with the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20


def _draw(key: Column, k: int) -> Column:
    """The k-th 8-digit group of the key's SHA-256 in hex, as an unsigned number."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 8 * k - 7, 8), 16, 10).cast("long")


def _join(units: Column) -> Column:
    return F.array_join(units, "")


def transform(docs: DataFrame, text: str = "text", ident: str = "doc_id", seed: str = "1:") -> DataFrame:
    """docs' columns and a struct `fim`: n (units), form (plain, psm or spm), prefix, middle and suffix (null if plain) and output.

    The cuts and the form hang on the seed and the identifier only, so equal ids fare alike whatever the order of rows; a null id counts
    as an empty one. Null texts count as empty; an empty text is plain, as is one that holds a sentinel. Texts of any length are cut
    whole, within their own row; nothing is shuffled. An empty table gives no rows. A column of docs named `fim` is replaced, all other
    columns stay whatever their names.
    """
    body, key = F.coalesce(F.col(text), F.lit("")), F.concat(F.lit(seed), F.coalesce(F.col(ident).cast("string"), F.lit("")))
    # Each step is a struct in the one column that is added, so no name of docs can be in the way; arrays are made once, as they are costly.
    drawn = docs.withColumn("fim", F.struct(body.alias("text"), F.regexp_extract_all(body, F.lit(UNIT), F.lit(0)).alias("units"), *(_draw(key, k).alias(f"h{k}") for k in (1, 2, 3, 4))))
    of = lambda name: F.col("fim")[name]
    n = F.size(of("units")).cast("long")
    kept = (of("text") == "") | of("text").rlike(_SENTINEL) | (of("h3") % 100 >= PLAIN_FROM)
    form = F.when(kept, "plain").when(of("h4") % 100 < SPM_BELOW, "spm").otherwise("psm")
    a, b = of("h1") % (n + 1), of("h2") % (n + 1)
    placed = drawn.withColumn("fim", F.struct(of("text").alias("text"), of("units").alias("units"), n.alias("n"), form.alias("form"), F.least(a, b).cast("int").alias("a"), F.greatest(a, b).cast("int").alias("b")))
    part = lambda start, length: F.when(of("form") != "plain", _join(F.slice(of("units"), start, length)))
    cut = placed.withColumn("fim", F.struct(
        of("text").alias("text"), of("n").alias("n"), of("form").alias("form"),
        part(F.lit(1), of("a")).alias("prefix"), part(of("a") + 1, of("b") - of("a")).alias("middle"), part(of("b") + 1, of("n").cast("int") - of("b")).alias("suffix"),
    ))
    return cut.withColumn("fim", F.struct(*(of(c).alias(c) for c in ("n", "form", "prefix", "middle", "suffix")), arranged(of("text"), of("form"), of("prefix"), of("middle"), of("suffix")).alias("output")))


def arranged(text: Column, form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A sentinel cannot arise where a part and a sentinel meet, so splitting at sentinels is exact; null where an output of that form cannot look so."""
    parts = F.split(output, _SENTINEL, -1)
    whole = (F.size(parts) == 4) & (parts[0] == "")
    psm = F.when(whole & output.startswith(PREFIX), F.concat(parts[1], parts[3], parts[2]))
    spm = F.when(whole & output.startswith(SUFFIX), F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = transform(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    of = lambda name: F.col("fim")[name]
    chars = lambda name: F.char_length(of(name)).cast("long")
    back = restored(of("output"), of("form"))
    return docs.select(
        "doc_id", of("n").alias("n"), of("form").alias("form"), chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"),
        F.sha2(of("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


ORACLE = f"""with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h, regexp_extract_all(coalesce(text, ''), '{UNIT}') as u from documents),
d as (select doc_id, text, u, len(u)::bigint as n, {', '.join(f"('0x' || substr(h, {8 * k - 7}, 8))::bigint as h{k}" for k in (1, 2, 3, 4))} from t),
c as (select *, case when text = '' or regexp_matches(text, '{_SENTINEL}') or h3 % 100 >= {PLAIN_FROM} then 'plain' when h4 % 100 < {SPM_BELOW} then 'spm' else 'psm' end as form,
least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from d),
p as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
sha256(case form when 'psm' then '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid when 'spm' then '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid else text end) as output_sha256,
sha256(text) as restored_sha256 from p"""

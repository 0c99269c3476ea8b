"""Duplicates hidden by formatting: records equal but for white space, letter case, punctuation or field order.

Byte-identical rows are collapsed first, with counts; only the distinct survivors are brought to canonical form, and are
grouped again on the full canonical texts, summing the counts. The canonical form keeps letters and digits in one case.
Texts are in NFC, so letters with different accents differ and composed ones don't depend on how they were written.

The survivors are written once, and everything after the two groupings works on digests of 128 bits: a survivor finds its
group by that of its canonical texts, a row its survivor by that of its raw texts, the latter only for survivors that
stand for several rows. (Among 10^12 texts two have the same digest with a chance of 10^-15.)

Defined results: null, missing and blank are one value, which agrees with itself only (a text of punctuation alone is
another); repeated rows count as copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions.columns import json_object
from ledgerloom.plans.materialise import Cuts

#: What stands for null, missing and blank. No canonical text has a space.
ABSENT = " "
#: Characters that are in NFC and start no composition: Latin, basic Greek and Cyrillic, general punctuation, kana, CJK, Hangul, full width.
STABLE = r"\x00-\x{2ff}\x{391}-\x{3ce}\x{400}-\x{482}\x{2002}-\x{206f}\x{3000}-\x{3029}\x{3041}-\x{3096}\x{30a1}-\x{30fe}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}\x{ff00}-\x{ffef}"
RESOLVER = r"^[^\p{L}\p{N}]*(?:(?:https?[^\p{L}\p{N}]*)?(?:(?:www|dx)\.)*doi\.org|doi(?=[^\p{L}\p{N}]))[^\p{L}\p{N}]*"
#: The same for engines whose patterns don't look ahead: the mark takes the character after it along, which is dropped anyway.
RESOLVER_SQL = r"^[^\p{L}\p{N}]*(?:(?:https?[^\p{L}\p{N}]*)?(?:(?:www|dx)\.)*doi\.org[^\p{L}\p{N}]*|doi[^\p{L}\p{N}]+)"


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """The text in NFC. Texts of characters that NFC leaves as they are stay in the JVM; Python gets null for them."""
    odd = F.coalesce(text.rlike(f"[^{STABLE}]"), F.lit(False))
    return F.coalesce(_compose(F.when(odd, text)), text)


def digest(*texts: Column) -> Column:
    """128 bits of texts and their order; null differs from the empty text."""
    whole = [x for t in texts for x in (t.isNull(), t)]
    return F.struct(F.xxhash64(*whole).alias("x"), F.xxhash64(F.lit("second"), *whole).alias("y"))


def _keep(text: Column) -> Column:
    """Letters, digits and uncomposed marks in one case; both foldings, since upper case joins forms that lower case keeps apart."""
    return F.lower(F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}\p{Mn}\p{Mc}]+|[\x{FE00}-\x{FE0F}]", "")))


def canonical(text: Column, resolver: bool = False) -> Column:
    """The canonical form of a text that is already in NFC; with ``resolver``, without leading resolver address or doi mark."""
    bare = text
    if resolver:  # a mark may follow an address and the other way round
        bare = F.regexp_replace(F.regexp_replace(F.lower(text), RESOLVER, ""), RESOLVER, "")
    blank = text.isNull() | text.rlike(r"^[\s\p{Z}]*$")
    return F.when(blank, ABSENT).otherwise(_keep(bare))


def from_json_payload(df: DataFrame, payload: str, fields: list[str]) -> DataFrame:
    """Add a column for each of ``fields`` from a JSON object whose keys count regardless of letter case.

    Rows whose payload is no complete JSON object are left out. Of keys that differ in case only, the first counts.
    """
    whole = json_object(F.col(payload)).isNotNull()
    items = F.from_json(F.when(whole, F.col(payload)), "map<string,string>")
    df = df.where(whole).withColumn("_items", items)
    pick = lambda f: F.get(F.map_values(F.map_filter("_items", lambda k, _: F.lower(k) == f)), F.lit(0))
    return df.withColumns({f: pick(f) for f in fields}).drop("_items")


def _named(records: DataFrame, id_column: str, fields: dict[str, bool]) -> DataFrame:
    """id, f0.. of the records, whatever their columns are called."""
    return records.select(F.col(id_column).alias("id"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])


def _survivors(records: DataFrame, resolver: list[bool]) -> DataFrame:
    """Distinct raw forms, written: c0.. (canonical texts), least (smallest id), n (rows), raw and form (digests of the raw and canonical texts)."""
    n = range(len(resolver))
    forms = records.groupBy(*[f"f{i}" for i in n]).agg(F.min("id").alias("least"), F.count("*").alias("n"))
    forms = forms.withColumns({f"t{i}": composed(F.col(f"f{i}")) for i in n})
    forms = forms.select(*[canonical(F.col(f"t{i}"), resolver[i]).alias(f"c{i}") for i in n], "least", "n", digest(*[F.col(f"f{i}") for i in n]).alias("raw"))
    forms = Cuts(records.sparkSession, "duplicates").cut(forms)
    return forms.withColumn("form", digest(*[F.col(f"c{i}") for i in n]))


def _groups(survivors: DataFrame) -> DataFrame:
    keys = [c for c in survivors.columns if re.fullmatch(r"c\d+", c)]
    return survivors.groupBy(*keys).agg(F.min("least").alias("keeper"), F.sum("n").alias("n_copies"))


def collapse(records: DataFrame, id_column: str, fields: dict[str, bool]) -> DataFrame:
    """c0.. (the canonical texts), keeper (smallest id) and n_copies of each group.

    ``fields`` maps each compared column to whether a resolver address is no part of it.
    """
    return _groups(_survivors(_named(records, id_column, fields), list(fields.values())))


def copies(records: DataFrame, id_column: str, fields: dict[str, bool]) -> DataFrame:
    """keeper, id of each record that is not the smallest id of its group.

    The smallest row of a raw form is known from the first grouping; only forms of several rows meet the rows again.
    """
    records = _named(records, id_column, fields)
    forms = _survivors(records, list(fields.values()))
    keys = [F.col(f"c{i}") for i in range(len(fields))]
    groups = _groups(forms).where("n_copies > 1").select(digest(*keys).alias("form"), "keeper")
    placed = forms.select("form", "raw", "least", "n").join(groups, "form").where("least <> keeper or n > 1").select("raw", "least", "n", "keeper")
    placed = Cuts(records.sparkSession, "duplicates").cut(placed)
    first = placed.where("least <> keeper").select("keeper", F.col("least").alias("id"))
    several = placed.where("n > 1").select("raw", "least", "keeper")
    rows = records.select("id", digest(*[F.col(f"f{i}") for i in range(len(fields))]).alias("raw")).join(several, "raw")
    return first.unionByName(rows.where("id <> least").select("keeper", "id"))

"""Extraction replies as deals; the extractor itself is a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clean_date, clean_list_variant, clean_states, clean_str, has_content
from ..functions.names import entity_name
from ..functions.text import text_gate

TEXTS = ["acquiring_entity", "seller_entity", "lender", "rationale"]
LISTS = ["operator_names", "facility_names", "states"]


def reply_json(reply: Column) -> Column:
    """The reply's JSON as a variant: fences off; text that is not JSON gives null."""
    bare = F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(reply, F.lit(" \t\r\n")), r"^```(?:json)?\s*", ""), r"\s*```$", ""), F.lit(" \t\r\n"))
    return F.try_parse_json(bare)


def reply_deals(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """A row (variant ``deal``, from 0 ``ord``) for each object of the reply; one object stands for a list of one."""
    v = reply_json(F.col(reply))
    many = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v)))
    return replies.select("*", F.posexplode(many).alias("ord", "deal"))


def cleaned(rows: DataFrame, *keep: str, model: str = "landed") -> DataFrame:
    """``keep`` columns and the cleaned fields of each ``deal``; deals that name nothing go."""
    text = lambda f: F.try_variant_get("deal", f"$.{f}", "string")
    item = lambda f: F.try_variant_get("deal", f"$.{f}", "variant")
    raw = [text(f) for f in ("acquiring_entity", "seller_entity")]
    lists = [clean_list_variant(item(f)) for f in ("operator_names", "facility_names", "states")]
    rows = rows.filter(has_content(raw, lists))
    whole = F.try_variant_get("deal", "$.facility_count", "int")
    number = lambda f: text(f).try_cast("double")
    return rows.select(
        *keep, *(clean_str(text(f)).alias(f) for f in TEXTS), clean_list_variant(item("operator_names")).alias("operator_names"), clean_list_variant(item("facility_names")).alias("facility_names"),
        clean_states(clean_list_variant(item("states"))).alias("states"), whole.alias("facility_count"), number("deal_value_m").alias("deal_value_m"), clean_date(text("acquisition_date")).alias("acquisition_date"),
        number("financing_amount_m").alias("financing_amount_m"), F.lit(model).alias("extraction_model"),
    )


def normalized(deals: DataFrame) -> DataFrame:
    """Display names of acquirer, seller and operators; facilities keep theirs."""
    names = {c: entity_name(F.col(c)) for c in ("acquiring_entity", "seller_entity")}
    return deals.withColumns(names | {"operator_names": F.transform("operator_names", entity_name)})


Extractor = Callable[[str], str]


def replies(articles: DataFrame, extractor: Extractor, *, text: str = "raw_text", strict: bool = False) -> DataFrame:
    """id, truncated, reply and error of each article that passes the gate; few words make it truncated.

    The extractor (text to JSON) runs in the tasks. What it raises is the
    article's error, or fails the job if ``strict``.
    """
    gated = text_gate(articles, text)

    def ask(x: str) -> tuple[str | None, str | None]:
        try:
            return extractor(x), None
        except Exception as e:
            if strict:
                raise
            return None, str(e) or type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = [ask(x) for x in b["_text"]]
            yield b[["id", "truncated"]].assign(reply=[a for a, _ in answers], error=[e for _, e in answers])

    kind = articles.schema["id"].dataType.simpleString()
    return gated.select("id", "truncated", F.col(text).alias("_text")).mapInPandas(run, f"id {kind}, truncated boolean, reply string, error string")


def replied_deals(answered: DataFrame, *, model: str = "plug-in") -> DataFrame:
    """Cleaned deals of ``replies``, by article_id and ord. Few words give low confidence."""
    out = cleaned(reply_deals(answered), "id", "ord", "truncated", model=model)
    return out.withColumn("confidence", F.when(F.col("truncated"), "low")).withColumnRenamed("id", "article_id").drop("truncated")


def extract(articles: DataFrame, extractor: Extractor, *, text: str = "raw_text", model: str = "plug-in") -> DataFrame:
    """Articles through the gate, the extractor and cleaning."""
    return replied_deals(replies(articles, extractor, text=text, strict=True), model=model)

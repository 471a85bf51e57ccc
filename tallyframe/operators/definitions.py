"""Ratio definitions as state: rows (company_id, name, category, formula, active, updated_at); a null company is common to all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import ASKED_RATIOS, CATEGORY_WORDS, OTHER_CATEGORY, RATIOS, TAGS

DEFINITION = "struct<company_id: bigint, name: string, category: string, formula: string>"
KEY = ["company_id", "name"]


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.company_id").eqNullSafe(F.col(f"{right}.company_id")) & (F.col(f"{left}.name") == F.col(f"{right}.name"))


def updated(definitions: DataFrame, changes: DataFrame, at: str) -> DataFrame:
    """Definitions with the formula and category of `changes` (company_id, name, and what isn't null of these); rows that change get `at` as updated_at. Changes of names that aren't there are left out."""
    out = definitions.alias("d").join(changes.alias("c"), _same("d", "c"), "left")
    touched = F.col("c.name").isNotNull()
    pick = {c: F.coalesce(F.col(f"c.{c}"), F.col(f"d.{c}")) for c in ("category", "formula")}
    rest = {"updated_at": F.when(touched, F.to_timestamp(F.lit(at))).otherwise(F.col("d.updated_at"))}
    return out.select(*((pick | rest).get(c, F.col(f"d.{c}")).alias(c) for c in definitions.columns))


def retired(definitions: DataFrame, names: DataFrame, at: str, hard: bool = False) -> DataFrame:
    """Definitions without those of `names` (company_id, name): marked inactive, or gone."""
    if hard:
        return definitions.alias("d").join(names.alias("n"), _same("d", "n"), "left_anti")
    marked = definitions.alias("d").join(names.select(*KEY).distinct().alias("n"), _same("d", "n"), "left")
    gone = F.col("n.name").isNotNull() & F.col("d.active")
    new = {"active": F.col("d.active") & F.col("n.name").isNull(), "updated_at": F.when(gone, F.to_timestamp(F.lit(at))).otherwise(F.col("d.updated_at"))}
    return marked.select(*(new.get(c, F.col(f"d.{c}")).alias(c) for c in definitions.columns))


def exported(definitions: DataFrame) -> DataFrame:
    """json: a document for each active definition."""
    return definitions.filter("active").select(F.to_json(F.struct("company_id", "name", "category", "formula"), {"ignoreNullFields": "false"}).alias("json"))


def imported(documents: DataFrame, at: str, json: str = "json") -> DataFrame:
    """Definitions of documents as exported() makes them; documents without a name or formula are left out."""
    out = documents.select(F.from_json(json, DEFINITION).alias("d")).select("d.*").filter("name is not null and formula is not null")
    return out.withColumns({"active": F.lit(True), "updated_at": F.to_timestamp(F.lit(at))})


def categories(definitions: DataFrame) -> DataFrame:
    """category, how many ratios it has, and which."""
    return definitions.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("name")).alias("names"))


def used_in(reports: DataFrame, definitions: DataFrame, key: list[str], nested: str = "categories") -> DataFrame:
    """Definitions of the ratios that nested reports {category: JSON of {ratio: value}} hold, with the number of reports. Names are made distinct by report before they move."""
    inner = F.flatten(F.transform(F.map_values(nested), lambda j: F.map_keys(F.from_json(j, "map<string, double>"))))
    used = reports.select(*key, F.explode(F.array_distinct(inner)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("reports"))
    return used.join(definitions.select("name", "category", "formula"), "name")


def tags_of_columns(facts: DataFrame, tags: dict[str, str] = TAGS) -> DataFrame:
    """column and all tags in use that are filed for it: the map of tags turned round."""
    from .facts import mapped

    return mapped(facts, tags).select("column", "tag").distinct().groupBy("column").agg(F.array_sort(F.collect_list("tag")).alias("tags"))


def categories_asked(asked: DataFrame, key: list[str], names: str = "ratios") -> DataFrame:
    """key and the categories (in order, without repeats) of the ratios asked for (an array): by the catalog's names or the others that they go by, in any case, spaces and dashes as underscores; of an unknown name by a part of it. Null names have none. The dimension is a constant of the plan."""
    known = {n.lower(): c for n, c, _ in RATIOS} | {n: c for c, own in ASKED_RATIOS.items() for n in own}
    dimension = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))

    def category(name: Column) -> Column:
        plain = F.translate(F.lower(F.trim(name)), " -", "__")
        guess = F.lit(OTHER_CATEGORY)
        for c, words in reversed(CATEGORY_WORDS.items()):
            guess = F.when(plain.rlike("|".join(words)), c).otherwise(guess)
        return F.when(name.isNotNull(), F.coalesce(F.try_element_at(dimension, plain), guess))

    found = F.filter(F.transform(names, category), lambda c: c.isNotNull())
    return asked.select(*key, F.array_sort(F.array_distinct(found)).alias("categories"))

"""Text of the sentences, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SentenceConfig


def feature_part(name: Column, category: Column) -> Column:
    """'name, category'; the category alone for a NULL or empty name."""
    has = F.nullif(name, F.lit("")).isNotNull()
    return F.when(has & category.isNotNull(), F.concat(name, F.lit(", "), category)).when(has, name).otherwise(F.coalesce(category, F.lit("")))


def group_part(key: Column, names: Column, sep: str = ", ") -> Column:
    """'a, key' / 'a und b, key' / 'a, b und c, key'; empty text without names."""
    n = F.size(names)
    many = F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), sep), F.lit(" und "), F.try_element_at(names, F.lit(-1)))
    text = F.when(n == 1, F.try_element_at(names, F.lit(1))).otherwise(many)
    return F.when(n < 1, F.lit("")).otherwise(F.when(key.isNull(), text).otherwise(F.concat(text, F.lit(", "), key)))


def section(prefix: str, groups: Column, cfg: SentenceConfig) -> Column:
    items = F.filter(F.transform(groups, lambda g: group_part(g["key"], g["names"], cfg.instance_separator)), lambda t: t != "")
    return F.when(F.size(items) > 0, F.concat(F.lit(prefix), F.array_join(items, cfg.category_separator)))


def sentence(name: Column, category: Column, context: Column, filler: Column, static: Column, cfg: SentenceConfig) -> Column:
    """Feature, 'bei' associated context, 'nahe' filler, 'in' static context; empty sections are left out."""
    items = F.flatten(F.transform(static, lambda g: F.transform(g["names"], lambda n: F.concat(n, F.lit(", "), g["key"]))))
    inside = F.when(F.size(items) > 0, F.concat(F.lit("in "), F.array_join(items, cfg.instance_separator)))
    return F.concat_ws(cfg.category_separator, feature_part(name, category), section("bei ", context, cfg), section("nahe ", filler, cfg), inside)

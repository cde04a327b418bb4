"""Filters of both grammars over index rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, filters, legacy_filters
from ..operators.filters import Condition as C
from ..plans import search as plans
from .base import IDX, Register, index

reg = Register()


def _where(name: str, column, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return index(spark, sf_dir).where(column()).select("entity_id", "source_name")

    reg.add(name, run, f"with {IDX} select entity_id, source_name from idx where {sql}")


def _one(name: str, field: str, operator: str, value, sql: str) -> None:
    _where(name, lambda: filters.condition(C(field, operator, value)), sql)


ISO, SECONDS = "2024-01-15T12:00:00Z", 1705320000
_one("f01_equals", "source_name", "equals", "src3", "source_name = 'src3'")
_one("f02_not_equals_null_passes", "updated_at", "not_equals", "2024-01-02T02:00:00Z", "updated_at is distinct from 1704160800")
_one("f03_contains", "name", "contains", "MENT 1", "contains(lower(name), 'ment 1')")
_one("f04_greater_than", "created_at", "greater_than", ISO, f"created_at > {SECONDS}")
_one("f05_less_than", "updated_at", "less_than", f"'{ISO}'", f"updated_at < {SECONDS}")
_one("f06_at_least", "chunk_index", "greater_than_or_equal", 3, "chunk_index >= 3")
_one("f07_at_most", "updated_at", "less_than_or_equal", ISO, f"updated_at <= {SECONDS}")
_one("f08_in", "source_name", "in", ["src1", "src5", "nope"], "source_name in ('src1', 'src5', 'nope')")
_one("f08_in_empty", "source_name", "in", [], "false")
_one("f09_not_in_null_passes", "updated_at", "not_in", [1704160800, 1704164400], "coalesce(updated_at not in (1704160800, 1704164400), true)")
_one("f09_not_in_empty", "source_name", "not_in", [], "true")
_one("f10_breadcrumb_equals", "breadcrumbs.name", "equals", "DE", "coalesce(list_contains([b.name for b in breadcrumbs], 'DE'), false)")
_one("f10_breadcrumb_not_in", "breadcrumbs.entity_id", "not_in", ["lang-en", "src2"], "not coalesce(list_has_any([b.entity_id for b in breadcrumbs], ['lang-en', 'src2']), false)")
_one("f13_list_from_text", "source_name", "in", "src4", "source_name in ('src4')")
_where("f11_groups", lambda: filters.groups([[C("source_name", "equals", "src1"), C("chunk_index", "equals", 1)], [C("entity_type", "equals", "WebPageEntity"), C("created_at", "less_than", ISO)]]), f"(source_name = 'src1' and chunk_index = 1) or (entity_type = 'WebPageEntity' and created_at < {SECONDS})")
_USER = [[C("source_name", "not_equals", "src1")], [C("chunk_index", "greater_than", 2)]]
_PLAN = [[C("entity_type", "equals", "DocumentEntity")], [C("name", "contains", "7")]]
_where("f16_user_filters_flat", lambda: filters.groups(filters.merged(_USER, _PLAN)), "(entity_type = 'DocumentEntity' or contains(name, '7')) and source_name <> 'src1' and chunk_index > 2")
_where("f16_user_filters_dnf", lambda: filters.groups(filters.merged(_USER, _PLAN, "dnf")), "(entity_type = 'DocumentEntity' or contains(name, '7')) and (source_name <> 'src1' or chunk_index > 2)")
_where("f17_tenant", lambda: filters.tenant("fr"), "collection_id = 'fr'")
_P = ["user:u3", "group:g1"]
_SEEN = "(coalesce(access_is_public, false) or coalesce(list_has_any(access_viewers, ['user:u3', 'group:g1']), false))"
_where("f18_visible", lambda: access.visible(_P), _SEEN)
_where("f18_public_only", lambda: access.visible([]), "coalesce(access_is_public, false)")
_where("f18_no_context", lambda: access.visible(None), "true")
_where("f19_visible_in_memory", lambda: access.visible_in_memory(_P), f"access_is_public is null or {_SEEN}")
_where("f20_may_open", lambda: access.may_open(_P), f"(access_is_public is null and access_viewers is null) or coalesce(access_is_public, false) or len(access_viewers) = 0 or coalesce(list_has_any(access_viewers, ['user:u3', 'group:g1']), false)")
_where("f21_name_substring", lambda: filters.name_contains("CUMENT 2"), "contains(lower(name), 'cument 2')")


@reg("f22_default_access", f"with {IDX} select entity_id, case when access_is_public is not null then access_is_public else not (source_name in ('src1', 'src2')) end as is_public from idx")
def _(spark, sf_dir):
    return index(spark, sf_dir).select("entity_id", access.default_access(F.col("source_name").isin("src1", "src2")).alias("is_public"))


def _old(name: str, found: dict, sql: str) -> None:
    _where(name, lambda: legacy_filters.translate(found), sql)


def _m(key, value):
    return {"key": key, "match": {"value": value}}


_old("l01_must_should", {"must": [_m("source_name", "src2")], "should": [_m("chunk_index", 1), _m("chunk_index", 2)]}, "source_name = 'src2' and chunk_index in (1, 2)")
_old("l02_must_not_denies_conjunction", {"must_not": [_m("source_name", "src2"), _m("chunk_index", 2)]}, "not (source_name = 'src2' and chunk_index = 2)")
_old("l03_nested_groups", {"must": [{"should": [_m("source_name", "src2"), {"must": [_m("chunk_index", 4), _m("entity_type", "WebPageEntity")]}]}]}, "source_name = 'src2' or (chunk_index = 4 and entity_type = 'WebPageEntity')")
_old("l04_match_viewer", {"must": [_m("access_viewers", "group:g2")]}, "coalesce(list_contains(access_viewers, 'group:g2'), false)")
_old("l05_match_any", {"must": [{"key": "source_name", "match": {"any": ["src7", "src8"]}}]}, "source_name in ('src7', 'src8')")
_old("l05_match_except", {"must": [{"key": "source_name", "match": {"except": ["src7", "src8"]}}]}, "source_name not in ('src7', 'src8')")
_old("l05_match_any_empty", {"must": [{"key": "source_name", "match": {"any": []}}]}, "false")
_old("l06_range", {"must": [{"key": "created_at", "range": {"gte": "2024-01-05T00:00:00Z", "lt": ISO}}]}, f"created_at >= 1704412800 and created_at < {SECONDS}")
_old("l07_has_id", {"must": [{"has_id": ["3__chunk_0", "5__chunk_0"]}]}, "entity_id in ('3__chunk_0', '5__chunk_0')")
_old("l08_is_null", {"must": [{"key": "updated_at", "is_null": True}]}, "updated_at is null")
_old("l09_is_empty", {"must": [{"key": "access_viewers", "is_empty": True}]}, "coalesce(len(access_viewers), 0) = 0")
_old("l10_values_count", {"must": [{"key": "breadcrumbs", "values_count": {"gte": 2}}]}, "coalesce(len(breadcrumbs), 0) >= 2")
_old("l11_nested_array", {"must": [{"nested": {"key": "breadcrumbs", "filter": {"must": [_m("name", "EN"), _m("entity_id", "src3")]}}}]}, "coalesce(list_contains([b.name for b in breadcrumbs], 'EN') and list_contains([b.entity_id for b in breadcrumbs], 'src3'), false)")
_where("l15_merged", lambda: legacy_filters.merged({"should": [_m("source_name", "src1"), _m("source_name", "src2")]}, {"should": [_m("chunk_index", 1), _m("chunk_index", 2)]}), "source_name in ('src1', 'src2') and chunk_index in (1, 2)")
_old("l15_minimum_should_match", {"should": [_m("source_name", "src1"), _m("chunk_index", 1), _m("entity_type", "WebPageEntity")], "minimum_should_match": 2}, "(source_name = 'src1')::int + (chunk_index = 1)::int + (entity_type = 'WebPageEntity')::int >= 2")
_where("l17_syncs_resolved", lambda: legacy_filters.syncs(["sync-1", "sync-4"]), "sync_id in ('sync-1', 'sync-4')")
_where("l17_no_sync_resolved", lambda: legacy_filters.syncs([]), "false")


@reg("n12_browse", f"with {IDX} select entity_id, name, source_name from idx where source_name in ('src0', 'src1', 'src2', 'src3', 'src5') and chunk_index = 0 order by entity_id limit 10 offset 2")
def _(spark, sf_dir):
    plan = plans.SearchPlan("", groups=[[C("source_name", "in", ["src0", "src1", "src2", "src3", "src5"])]], limit=10, offset=2)
    return plans.browse(plan, index(spark, sf_dir)).select("entity_id", "name", "source_name")


@reg("a09_count", f"with {IDX} select count(*) as n from idx where source_name = 'src3' and {_SEEN}")
def _(spark, sf_dir):
    plan = plans.SearchPlan("", groups=[[C("source_name", "equals", "src3")]], principals=_P)
    return index(spark, sf_dir).where(plan.predicate()).agg(F.count(F.lit(1)).alias("n"))

"""The stored knowledge graphs of sites: a refresh replaces all rows of its sites at once, under the ids that they had.

Entities, edges and evidence lie in one bucket store, so a refresh is one commit: either
all of a site's rows are new, or none.  Ids are given once for each site and key, in
the order of both, and are kept for keys that go and come back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.operators import graph
from pagelens.operators.bucket_store import BucketStore, Commit
from pagelens.operators.shared import cut, numbered

VERSION = "site-graph-v1"
BUILT_NOTE = "Projected from page snapshots and discovery signals."
REUSED_NOTE = "Reused latest site knowledge graph snapshot from task "
REUSED_NOTE_NO_TASK = "Reused latest site knowledge graph snapshot for this task."
OTHER_TASK_NOTE = "Using the latest site-level knowledge graph snapshot because no exact snapshot was stored for this task."
NOT_BUILT_NOTE = "Knowledge graph has not been built for this task yet."

SNAPSHOTS = "graph_snapshot_id long, site_id string, task_id string, graph_version string, source_snapshot_count long, entity_count long, edge_count long, evidence_count long, entities string, edges string, evidence string, note string, built_at timestamp"
_KEPT = {
    "entities": ["site_id", "entity_id", "entity_key", "entity_type", "name", "entity_url", "source_page_id", "confidence", "attributes"],
    "edges": ["site_id", "edge_id", "edge_key", "from_entity_id", "to_entity_id", "relation_type", "confidence", "evidence_count", "attributes", "first_seen_at", "last_seen_at"],
    "evidence": ["site_id", "evidence_id", "entity_id", "edge_id", "page_id", "evidence_type", "evidence_field", "evidence_path", "evidence_text", "confidence"],
}


@dataclass(frozen=True)
class Graph:
    """The rows of a refresh: merged entities and edges with attributes, evidence, and the sites that they are all of."""

    entities: DataFrame
    edges: DataFrame
    evidence: DataFrame
    sites: DataFrame


def projected(profiles: DataFrame, signals: DataFrame, known: DataFrame | None = None) -> Graph:
    """The graph of the profiles' sites; signals: rollup.site_signals of the same pages."""
    entities, edges = map(cut, graph.structure_candidates(profiles, known, full=True))  # several merges read them
    sites = profiles.where("page_url is not null").select("site_id").distinct()
    return Graph(graph.merge_entities_fully(entities, graph.site_candidates(signals)), graph.merge_edges_fully(edges), graph.stored_evidence(edges), sites)


class GraphStore(BucketStore):
    def _ids(self, base, kind: str, keys: DataFrame, buckets: list[int]) -> tuple[DataFrame, DataFrame, int]:
        """(site_id, key, id) of the keys; all that the buckets hold now; and the last id given.  Keys that have none yet get the next ones."""
        held = self.read(f"{kind}_ids", buckets, base)
        held = self.spark.createDataFrame([], "site_id string, key string, id long") if held is None else held
        new = keys.select("site_id", "key").distinct().join(held, ["site_id", "key"], "left_anti")
        given, last = numbered(new, ["site_id", "key"], base.counters.get(kind, 0), "id")
        every = cut(held.unionByName(given.select("site_id", "key", "id")))
        return every.join(keys.select("site_id").distinct(), "site_id", "left_semi"), every, last

    def refresh(self, fresh: Graph) -> Commit:
        """Put a graph in place of all that is stored of its sites, also where it has no rows for one.

        Rows without site_id are left out.  Edges without either end among the entities drop out, and evidence of entities or
        edges that are not there.  A key that stands twice counts once: the row with the greater
        confidence, then the last by its other columns as JSON.
        """
        sites = cut(fresh.sites.select("site_id").where("site_id is not null").distinct())
        base, touched = self.manifest(), self.buckets_of_sites(sites)

        def one_each(rows: DataFrame, key: str) -> DataFrame:
            names = [c for c in rows.columns if c not in ("site_id", key)]
            order = F.struct("confidence", F.to_json(F.struct(*names)).alias("text"))
            picked = rows.join(sites, "site_id", "left_semi").groupBy("site_id", key).agg(F.max_by(F.struct(*names), order).alias("_row"))
            return picked.select("site_id", key, "_row.*")

        entities = cut(one_each(fresh.entities, "entity_key"))
        ids, all_entity_ids, last_entity = self._ids(base, "entity", entities.withColumnRenamed("entity_key", "key"), touched)
        end = lambda side, name: entities.join(ids.withColumnRenamed("key", "entity_key"), ["site_id", "entity_key"]).select("site_id", F.col("entity_key").alias(side), F.col("id").alias(name))
        edges = cut(one_each(fresh.edges, "edge_key").join(end("source_key", "from_entity_id"), ["site_id", "source_key"]).join(end("target_key", "to_entity_id"), ["site_id", "target_key"]))
        edge_ids, all_edge_ids, last_edge = self._ids(base, "edge", edges.withColumnRenamed("edge_key", "key"), touched)
        live_edges = edges.join(edge_ids.withColumnRenamed("key", "edge_key"), ["site_id", "edge_key"]).withColumnRenamed("id", "edge_id")
        live_entities = entities.join(ids.withColumnRenamed("key", "entity_key"), ["site_id", "entity_key"]).withColumnRenamed("id", "entity_id")

        shown = fresh.evidence.join(sites, "site_id", "left_semi")
        shown = shown.join(live_entities.select("site_id", "entity_key", "entity_id"), ["site_id", "entity_key"], "left").join(live_edges.select("site_id", "edge_key", "edge_id"), ["site_id", "edge_key"], "left")
        shown = shown.where("(entity_key is null or entity_id is not null) and (edge_key is null or edge_id is not null)")
        evidence, last_evidence = numbered(shown, ["site_id", "edge_key", "entity_key", "page_id", "nth", "evidence_field", "evidence_text"], base.counters.get("evidence", 0), "evidence_id")

        new = {"entities": (live_entities, "entity_key"), "edges": (live_edges, "edge_key"), "evidence": (evidence, "evidence_id")}
        changes = {}
        for table, (rows, _) in new.items():
            rows, old = rows.select(*_KEPT[table]), self.read(table, touched, base)
            others = None if old is None else old.join(sites, "site_id", "left_anti")
            changes[table] = (rows if others is None else others.select(*rows.columns).unionByName(rows), self._by(table), touched)
        changes |= {"entity_ids": (all_entity_ids, self.bucket(F.col("site_id"), F.col("key")), touched), "edge_ids": (all_edge_ids, self.bucket(F.col("site_id"), F.col("key")), touched)}
        return self.commit(base, changes, {"entity": last_entity, "edge": last_edge, "evidence": last_evidence})

    def _by(self, table: str) -> Column:
        return self.bucket(F.col("site_id"), F.col({"entities": "entity_key", "edges": "edge_key"}.get(table, "evidence_id")).cast("string"))

    def table(self, name: str, sites: DataFrame | None = None, manifest=None) -> DataFrame:
        rows = self.read(name, None if sites is None else self.buckets_of_sites(sites), manifest)
        if rows is None:
            raise LookupError(f"{name}: nothing stored")
        return rows if sites is None else rows.join(sites.select("site_id").distinct(), "site_id", "left_semi")

    def edges_read(self, sites: DataFrame | None = None) -> DataFrame:
        """Stored edges with keys and names of both ends."""
        now = self.manifest()
        entities = self.table("entities", sites, now)
        end = lambda side: entities.select(F.col("entity_id").alias(f"{side}_entity_id"), F.col("entity_key").alias(f"{side}_entity_key"), F.col("name").alias(f"{side}_entity_name"))
        return self.table("edges", sites, now).join(end("from"), "from_entity_id").join(end("to"), "to_entity_id")

    def evidence_read(self, sites: DataFrame | None = None) -> DataFrame:
        """Stored evidence with the keys of the entity and the edge that it shows, null where it names none."""
        now = self.manifest()
        entities = self.table("entities", sites, now).select("entity_id", "entity_key")
        edges = self.table("edges", sites, now).select("edge_id", "edge_key")
        return self.table("evidence", sites, now).join(entities, "entity_id", "left").join(edges, "edge_id", "left")

"""Tags, entity resolution, ontology checks and bounded graph expansion."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as X
from ..session import cut, stored

# Tag prefix -> (type, measurement, class).
TAG_PREFIXES: dict[str, tuple[str, str | None, str | None]] = {
    "AIC": ("Sensor", "analytical", None), "AT": ("Sensor", "analytical", None),
    "FIC": ("Sensor", "flow", None), "FT": ("Sensor", "flow", None), "FE": ("Sensor", "flow", None), "FI": ("Sensor", "flow", None),
    "LIC": ("Sensor", "level", None), "LT": ("Sensor", "level", None), "LI": ("Sensor", "level", None),
    "PIC": ("Sensor", "pressure", None), "PT": ("Sensor", "pressure", None), "PI": ("Sensor", "pressure", None),
    "TIC": ("Sensor", "temperature", None), "TE": ("Sensor", "temperature", None), "TI": ("Sensor", "temperature", None),
    "XV": ("Equipment", None, "valve"), "CV": ("Equipment", None, "valve"), "VLV": ("Equipment", None, "valve"),
    "CMP": ("Equipment", None, "compressor"), "PMP": ("Equipment", None, "pump"), "AG": ("Equipment", None, "agitator"),
    "HX": ("Equipment", None, "heat_exchanger"), "EX": ("Equipment", None, "exchanger"), "MCC": ("Equipment", None, "motor_control_center"),
    "R": ("Equipment", None, "reactor"), "TK": ("Equipment", None, "tank"), "K": ("Equipment", None, "compressor"), "M": ("Equipment", None, "motor"),
    "C": ("Equipment", None, "compressor"), "E": ("Equipment", None, "exchanger"), "T": ("Equipment", None, "tank"), "V": ("Equipment", None, "vessel"),
    "P": ("Equipment", None, "pump"), "TRAIN": ("Asset", None, None), "UNIT": ("Asset", None, None),
}
# Required properties of node types and allowed relations.
REQUIRED_PROPERTIES = {
    "Asset": ("tag_number", "name"), "Equipment": ("tag_number", "equipment_class"), "Sensor": ("tag_number", "measurement_type"),
    "FailureMode": ("failure_code", "description"), "Procedure": ("procedure_id", "title", "procedure_type"), "Document": ("source_id", "title", "document_type"),
    "Maintenance": ("work_order_id", "maintenance_type"), "Inspection": ("inspection_id", "inspection_type"), "Regulation": ("regulation_id", "title", "issuing_body"),
    "Personnel": ("personnel_id", "role"), "Process": ("process_id", "process_name"), "LessonLearned": ("lesson_id", "asset_tag", "incident_date", "description"),
}
ALLOWED_RELATIONS = (
    ("Sensor", "MONITORS", "Equipment"), ("Sensor", "MONITORS", "Asset"), ("Equipment", "IS_PART_OF", "Asset"), ("Equipment", "IS_PART_OF", "Equipment"),
    ("Equipment", "EXHIBITS", "FailureMode"), ("FailureMode", "INDICATES_FAILURE_OF", "Equipment"), ("FailureMode", "INDICATES_FAILURE_OF", "Asset"),
    ("Document", "REFERENCES", "Equipment"), ("Document", "REFERENCES", "Asset"), ("Document", "REFERENCES", "Procedure"), ("Document", "REFERENCES", "Regulation"), ("Regulation", "REFERENCES", "Procedure"),
    ("Maintenance", "PERFORMED_BY", "Personnel"), ("Inspection", "PERFORMED_BY", "Personnel"), ("Equipment", "REQUIRES", "Procedure"), ("Asset", "REQUIRES", "Procedure"), ("Process", "REQUIRES", "Equipment"),
    ("LessonLearned", "RELATED_TO", "Equipment"), ("LessonLearned", "REFERENCES", "FailureMode"),
)


@dataclass(frozen=True)
class Ontology:
    """Node specifications and allowed triples; as tables they have as many rows as the configuration."""

    required: dict[str, tuple[str, ...]]
    triples: tuple[tuple[str, str, str], ...]

    def __post_init__(self) -> None:
        strange = [t for t in self.triples if t[0] not in self.required or t[2] not in self.required]
        if strange:
            raise ValueError(f"relations between unknown node types: {strange}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Ontology":
        """Of a JSON file (YAML where that library is installed) with ``version``, ``node_types`` and ``allowed_relations``."""
        text = spark.read.text(path, wholetext=True).first()[0]
        try:
            raw = json.loads(text)
        except ValueError:
            import yaml

            raw = yaml.safe_load(text)
        if not isinstance(raw, dict) or (lacking := [k for k in ("version", "node_types", "allowed_relations") if k not in raw]):
            raise ValueError(f"an ontology lacks {lacking if isinstance(raw, dict) else 'its keys'}")
        if not isinstance(raw["node_types"], dict) or not raw["node_types"] or not isinstance(raw["allowed_relations"], list):
            raise ValueError("node_types has to be a filled object, allowed_relations an array")
        for name, own in raw["node_types"].items():
            listed = [own.get("required_properties"), own.get("optional_properties", [])] if isinstance(own, dict) else [None]
            if not all(isinstance(x, list) and all(isinstance(p, str) for p in x) for x in listed):
                raise ValueError(f"node type {name} needs lists of property names")
        triples = [tuple(r.get(k) for k in ("source", "relation", "target")) for r in raw["allowed_relations"] if isinstance(r, dict)]
        if len(triples) < len(raw["allowed_relations"]) or not all(isinstance(x, str) for t in triples for x in t):
            raise ValueError("a relation needs source, relation and target")
        return cls({k: tuple(v["required_properties"]) for k, v in raw["node_types"].items()}, tuple(triples))

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, list(v)) for k, v in self.required.items()], "node_type string, required array<string>")

    def relations(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.triples), "source_type string, relation string, target_type string")


INDUSTRIAL = Ontology(REQUIRED_PROPERTIES, ALLOWED_RELATIONS)


def classify_tags(tag: Column) -> Column:
    """``struct(entity_type, measurement, class)`` of a tag by the letters before an optional dash or blank and a digit.

    A known prefix has to be followed by those, so it is the whole run of letters: one look-up tells the longest.
    """

    def row(kind: str, measurement: str | None, own: str | None) -> Column:
        return F.struct(F.lit(kind).alias("entity_type"), F.lit(measurement).cast("string").alias("measurement"), F.lit(own).cast("string").alias("class"))

    known = F.create_map(*(x for prefix, values in TAG_PREFIXES.items() for x in (F.lit(prefix), row(*values))))
    return F.coalesce(F.try_element_at(known, F.regexp_extract(F.upper(tag), r"^([A-Z]+)[- ]?\d", 1)), row("Equipment", None, "general"))


def extract_entities(chunks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, pos, tag, entity_type, measurement, class`` of every tag in a text."""
    # Outer, since explode infers a filter that would search the text a second time.
    found = chunks.select(*keys, F.posexplode_outer(X.tags(F.col(text))).alias("pos", "tag")).where("pos IS NOT NULL").withColumn("tag", F.upper("tag"))
    return found.withColumn("_c", classify_tags(F.col("tag"))).select(*keys, "pos", "tag", "_c.*")


def deletion_variants(tag: Column, most: int = 2) -> Column:
    """The tag with up to ``most`` characters taken out; strings within that edit distance share a variant."""
    out = F.array(tag)
    for _ in range(most):
        shorter = F.flatten(F.transform(out, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda k: F.concat(F.substring(t, F.lit(1), k - 1), F.substr(t, k + 1)))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def digits(tag: Column) -> Column:
    return F.regexp_replace(tag, r"\D", "")


#: Deletion variants that one task of a join takes.
TASK_VARIANTS = 50_000


def similar_tags(tags: DataFrame, strict: bool = False, most: int = 2) -> DataFrame:
    """Pairs ``entity_type, a, b, distance`` of distinct tags of one type within ``most`` edits.

    Blocked on deletion variants, which loses no pair. ``strict`` asks for equal digits besides: FT-101 isn't FT-102.
    """
    own = tags.select("entity_type", "tag").distinct()
    keyed = own.select("entity_type", "tag", F.explode(deletion_variants(F.col("tag"), most)).alias("variant"))
    block = ["entity_type", "variant"] + (["digits"] if strict else [])
    if strict:
        keyed = keyed.withColumn("digits", digits(F.col("tag")))
    # A small shuffle becomes many pairs: as many tasks as the variants ask for, and far pairs leave before equal ones are sought.
    keyed = stored(keyed, "variants")
    dealt = keyed.repartition(max(1, -(-keyed.count() // TASK_VARIANTS)), *block)
    met = dealt.withColumnRenamed("tag", "a").join(dealt.withColumnRenamed("tag", "b"), block).where("a < b")
    near = met.select("entity_type", "a", "b", F.levenshtein("a", "b", most).alias("distance")).where("distance >= 0")
    return near.distinct()


#: Rows of a group that are resolved as one array.
FOLD = 256


def _folded(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """Groups as sorted arrays, each passed over once with the sets' canonical tags and the rows' places; a set ends with its first tag of the least length."""
    each = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("_rows"))
    start = F.struct(F.array().cast("array<string>").alias("sets"), F.array().cast("array<int>").alias("places"))

    def step(state: Column, row: Column) -> Column:
        tag, sets = row["tag"], state["sets"]
        place = F.coalesce(F.array_position(F.transform(sets, lambda c: F.levenshtein(c, tag, most) >= 0), True), F.lit(0)).cast("int")
        shorter = F.length(tag) < F.length(F.get(sets, place - 1))
        longer = F.when(place == 0, F.array_append(sets, tag)).when(shorter, F.transform(sets, lambda c, k: F.when(k == place - 1, tag).otherwise(c))).otherwise(sets)
        own = F.when(place == 0, F.size(sets) + 1).otherwise(place)
        return F.when(tag.isNull(), F.struct(sets.alias("sets"), F.array_append(state["places"], F.lit(None).cast("int")).alias("places"))).otherwise(F.struct(longer.alias("sets"), F.array_append(state["places"], own).alias("places")))

    told = each.select(*key, "_rows", F.aggregate("_rows", start, step).alias("_s"))
    named = F.zip_with("_rows", "_s.places", lambda r, p: F.struct(r["pos"].alias("pos"), r["tag"].alias("tag"), F.get(F.col("_s.sets"), p - 1).alias("canonical")))
    return told.select(*key, F.explode_outer(named).alias("_r")).select(key[0], "_r.pos", "_r.tag", key[1], "_r.canonical")


def resolve_greedy(entities: DataFrame, group: str, most: int = 2, fold: int = FOLD) -> DataFrame:
    """``group, pos, tag, entity_type, canonical``: within each ``group``, in order of ``pos`` (then ``tag``), a tag joins the first
    earlier set of its type within ``most`` edits of its canonical tag; the shorter tag becomes canonical.

    The order is the rule, so one group's rows of one type are one task's. A group of up to ``fold`` rows is one sorted array that a
    fold in the JVM passes over. Rows of larger groups pass by sorted, and only the canonical tags are held; what a set is called in the end
    is an aggregate there: its first tag of the least length. Groups and types may be null and
    are keys like others then; a null tag stays by itself and has no canonical tag.
    """
    key = [group, "entity_type"]

    def near(a: str, b: str) -> bool:
        if abs(len(a) - len(b)) > most:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1] <= most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = functools.lru_cache(maxsize=100_000)(near)
        current, canonical = object(), []  # the key whose rows pass by, and its sets' canonical tags
        for batch in batches:
            places = []
            for *own, tag in zip(*(batch.column(c).to_pylist() for c in (*key, "tag")), strict=True):
                if own != current:
                    current, canonical = own, []
                if tag is None:
                    places.append(None)
                    continue
                place = next((k for k, c in enumerate(canonical) if known(c, tag)), len(canonical))
                if place == len(canonical):
                    canonical.append(tag)
                elif len(tag) < len(canonical[place]):
                    canonical[place] = tag
                places.append(place)
            yield batch.append_column("_place", pa.array(places, pa.int64()))

    whole = entities.select(*key, F.col("pos").cast("long").alias("pos"), "tag")
    large = cut(whole.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > fold))
    if large.isEmpty():
        return _folded(whole, key, most)
    match = functools.reduce(Column.__and__, (F.col(f"w.`{c}`").eqNullSafe(F.col(f"l.`{c}`")) for c in key))
    small, whole = (whole.alias("w").join(large.alias("l"), match, how) for how in ("left_anti", "left_semi"))
    rows = whole.repartition(*key).sortWithinPartitions(*key, "pos", "tag")
    placed = stored(rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_place", LongType())])), "places")
    named = placed.groupBy(*key, "_place").agg(F.min_by("tag", F.struct(F.length("tag"), "pos", "tag")).alias("canonical")).alias("n")
    same = [F.col(f"p.`{c}`").eqNullSafe(F.col(f"n.`{c}`")) for c in (*key, "_place")]
    passed = placed.alias("p").join(named, functools.reduce(Column.__and__, same)).select(f"p.`{group}`", "p.pos", "p.tag", "p.entity_type", "n.canonical")
    return _folded(small, key, most).unionByName(passed)


def _stated(entities: DataFrame, field: str, name: str) -> Column:
    """A field, or what the property bag (map column ``props``, if there is one) says in its place."""
    own = F.nullif(F.col(field), F.lit(""))
    return F.coalesce(own, F.nullif(F.col("props")[name], F.lit(""))) if "props" in entities.columns else own


def resolve_models(entities: DataFrame) -> DataFrame:
    """Equipment with one manufacturer and model (trimmed, upper case) is one: its first tag by ``seq`` is canonical."""
    maker, model = _stated(entities, "manufacturer", "manufacturer"), _stated(entities, "model", "model_number")
    both = (F.col("entity_type") == "Equipment") & maker.isNotNull() & model.isNotNull()
    marked = entities.withColumns({"_m": F.when(both, F.upper(F.trim(maker))), "_k": F.when(both, F.upper(F.trim(model)))})
    first = marked.where("_m IS NOT NULL").groupBy("_m", "_k").agg(F.min_by("tag", "seq").alias("canonical"))
    return marked.join(first, ["_m", "_k"], "left").withColumn("canonical", F.coalesce("canonical", "tag")).drop("_m", "_k")


def merge_entities(entities: DataFrame) -> DataFrame:
    """One row per canonical tag: the shortest tag with its text, first known manufacturer and model, members' count.

    With property bags (``props``) also their union; of two values of a property the first by ``seq``, the canonical one's, wins.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    key = ["entity_type", "canonical"]
    merged = entities.groupBy(*key).agg(F.min_by("tag", F.struct(F.length("tag"), "seq")).alias("tag"), first("manufacturer").alias("manufacturer"), first("model").alias("model"), F.count("*").alias("members"))
    if "props" not in entities.columns:
        return merged
    values = entities.select(*key, "seq", F.explode("props").alias("_k", "_v")).groupBy(*key, "_k").agg(F.min_by("_v", "seq").alias("_v"))
    bags = values.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("props"))
    return merged.join(bags, key, "left").withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))


def check_nodes(nodes: DataFrame, ontology: Ontology = INDUSTRIAL) -> DataFrame:
    """``nodes(node_type, props map)`` with ``missing`` properties and ``valid``; unknown types are invalid."""
    spec = F.broadcast(ontology.nodes(nodes.sparkSession))  # as many rows as node types
    missing = F.array_except("required", F.map_keys(F.map_filter("props", lambda _, v: v.isNotNull() & (v != ""))))
    return nodes.join(spec, "node_type", "left").withColumn("missing", missing).withColumn("valid", F.coalesce(F.size("missing") == 0, F.lit(False))).drop("required")


def check_relations(edges: DataFrame, ontology: Ontology = INDUSTRIAL) -> tuple[DataFrame, DataFrame]:
    """Allowed and rejected edges by ``source_type, relation, target_type``."""
    allowed = F.broadcast(ontology.relations(edges.sparkSession))  # as many rows as triples
    on = ["source_type", "relation", "target_type"]
    return edges.join(allowed, on, "left_semi"), edges.join(allowed, on, "left_anti")


#: Edges that one task of a merge takes.
TASK_EDGES = 500_000


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges whose ends exist with the stated types."""
    ends = nodes.select("tag", "node_type").distinct()
    parts = max(1, -(-edges.count() // TASK_EDGES))  # as many tasks as the edges ask for, so that none holds more of them as they grow
    out = edges.repartition(parts, "src", "relation", "dst").dropDuplicates(["src", "relation", "dst", "source_type", "target_type"])
    for side, kind in (("src", "source_type"), ("dst", "target_type")):
        out = out.repartition(parts, side, kind).join(ends.select(F.col("tag").alias(side), F.col("node_type").alias(kind)), [side, kind], "left_semi")
    return out.dropDuplicates(["src", "relation", "dst"])


#: A hub holds more than one in HUB_SHARE of all steps (so there are at most HUB_SHARE hubs) and HUB_STEPS; its steps are dealt over PARTS tasks.
HUB_SHARE, HUB_STEPS, PARTS = 1000, 1000, 64


class Steps:
    """Edges from each of their ends, ``node, next, src, relation, dst``, those of hubs dealt by their other end."""

    def __init__(self, edges: DataFrame) -> None:
        ends = lambda a, b: edges.select(F.col(a).alias("node"), F.col(b).alias("next"), "src", "relation", "dst")
        self.rows = ends("src", "dst").unionByName(ends("dst", "src").where("src <> dst"))
        counts = self.rows.groupBy("node").agg(F.count("*").alias("_n"))
        total = edges.count() * 2
        self.hubs = F.broadcast(counts.where(F.col("_n") > max(total / HUB_SHARE, HUB_STEPS)).select("node", F.lit(True).alias("_hub")))
        part = F.when(F.col("_hub"), F.pmod(F.xxhash64("next", "relation"), F.lit(PARTS))).otherwise(0).cast("int")
        self.dealt = self.rows.join(self.hubs, "node", "left").withColumn("_part", part).drop("_hub")

    def of(self, frontier: DataFrame, dealt: DataFrame | None = None) -> DataFrame:
        """``seed, node`` with all steps of the node; a hub's frontier row goes to each of its parts."""
        parts = F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
        sent = frontier.join(self.hubs, "node", "left").withColumn("_part", F.explode(parts)).drop("_hub")
        return sent.join(self.dealt if dealt is None else dealt, ["node", "_part"])

    def first(self, limit: int) -> DataFrame:
        """Of each node (and part) the first steps in order, outwards and inwards; Spark limits them before it shuffles."""
        order = W.partitionBy("node", "_part", F.col("node") == F.col("src")).orderBy("src", "relation", "dst")
        return self.dealt.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= limit).drop("_k")


def expand(seeds: DataFrame, edges: DataFrame, depth: int = 2, limit: int | None = None) -> DataFrame:
    """``seed, src, relation, dst``: edges among all nodes within ``depth`` steps of each seed, either direction.

    Edges that touch a node nearer than ``depth`` belong whatever their other end is, so only those between two nodes of the last level
    have to be looked for. With a limit a seed gets its first edges by ``src, relation, dst``: a node sends no more steps than that, and the last
    level is only entered as far as names come before the last edge that is known already. Steps of hubs are dealt over several tasks.
    Edges that lack an end are dropped; a seed without edges gives no row and disturbs no other.
    """
    depth = max(1, min(depth, 3))
    whole = stored(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "relation", "dst").distinct(), "edges")
    steps, edge = Steps(whole), ["seed", "src", "relation", "dst"]

    def first(rows: DataFrame) -> DataFrame:
        order = W.partitionBy("seed").orderBy("src", "relation", "dst")
        return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r") if limit else rows

    inner = frontier = seeds.select("seed", F.col("seed").alias("node")).distinct()
    for _ in range(depth - 1):
        frontier = stored(steps.of(frontier).select("seed", F.col("next").alias("node")).distinct().join(inner, ["seed", "node"], "left_anti"), "frontier")
        inner = inner.unionByName(frontier)
    touching = first(steps.of(inner, steps.first(limit) if limit else None).select(*edge).distinct())
    outer = steps.of(frontier).select("seed", F.col("next").alias("node"))
    if limit:
        touching = stored(touching, "touching")
        last = touching.groupBy("seed").agg(F.when(F.count("*") >= limit, F.max("src")).alias("_last"))
        outer = outer.join(last, "seed").where("_last IS NULL OR node <= _last")
    outer = stored(outer.select("seed", "node").distinct().join(inner, ["seed", "node"], "left_anti"), "outer")
    # With a limit an end beyond the last known name may be missing in ``outer``: ends are looked up among all nodes of the last level.
    ends = steps.of(frontier).select("seed", F.col("next").alias("dst")).distinct() if limit else outer.withColumnRenamed("node", "dst")
    # Both ends lie in somebody's last level: what no seed can have leaves before it meets the seeds.
    last_nodes = stored(outer.select("node").distinct(), "last-nodes")
    met = steps.dealt.join(frontier.select("node").distinct(), "node", "left_semi").select("next").distinct() if limit else last_nodes.withColumnRenamed("node", "next")
    inside = stored(steps.dealt.where("node = src").join(last_nodes, "node", "left_semi").join(met, "next", "left_semi"), "inside")
    between = steps.of(outer.join(inside.select("node").distinct(), "node", "left_semi"), inside).select(*edge).join(ends, ["seed", "dst"], "left_semi")
    if limit:
        between = between.join(inner.withColumnRenamed("node", "dst"), ["seed", "dst"], "left_anti")  # known already
    return first(touching.unionByName(between.select(*edge)))


def summarise(seeds: DataFrame, subgraph: DataFrame, types: DataFrame) -> DataFrame:
    """Nodes, edges and sorted node types of each seed's subgraph; the seed is always a node, known types beat unknown."""
    ends = subgraph.select("seed", F.explode(F.array("src", "dst")).alias("tag")).unionByName(seeds.select("seed", F.col("seed").alias("tag"))).distinct()
    known = types.groupBy("tag").agg(F.collect_set(F.coalesce("node_type", F.lit("Unknown"))).alias("_types"))
    told = F.coalesce("_types", F.array(F.lit("Unknown")))
    typed = ends.join(known, "tag", "left").select("seed", "tag", told.alias("_types"))
    nodes = typed.groupBy("seed", "_types").agg(F.count("tag").alias("_n")).groupBy("seed").agg(F.sum("_n").alias("n_nodes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_types")))).alias("node_types"))
    return nodes.join(subgraph.groupBy("seed").agg(F.count("*").alias("n_edges")), "seed", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


#: Parts that rows are counted by before any key is.
COUNT_PARTS = 1 << 16


def heavy(rows: DataFrame, key: str) -> DataFrame:
    """``key`` values with more than one in HUB_SHARE of all rows and HUB_STEPS, so HUB_SHARE of them at most; only keys of full parts are counted by themselves."""
    part = F.pmod(F.xxhash64(key), F.lit(COUNT_PARTS)).alias("_p")
    parts = cut(rows.groupBy(part).agg(F.count("*").alias("_n")))
    most = max((parts.agg(F.sum("_n")).first()[0] or 0) / HUB_SHARE, HUB_STEPS)
    full = F.broadcast(parts.where(F.col("_n") > most).select("_p"))
    counts = rows.select(key, part).join(full, "_p", "left_semi").groupBy(key).agg(F.count("*").alias("_n"))
    return cut(counts.where(F.col("_n") > most).select(key))


def next_lists(edges: DataFrame) -> DataFrame:
    """``src, nexts``: the other ends of a node's edges, one for each distinct edge, as a list; hubs have several lists."""
    whole = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "relation", "dst")
    hubs = F.broadcast(heavy(whole, "src").withColumn("_hub", F.lit(True)))
    part = F.when(F.col("_hub"), F.pmod(F.xxhash64("dst", "relation"), F.lit(PARTS))).otherwise(0)
    dealt = whole.join(hubs, "src", "left").withColumn("_part", part).drop("_hub").repartition("src", "_part")
    ends = dealt.groupBy("src", "_part").agg(F.collect_set(F.struct("dst", "relation")).alias("_ends"))
    return stored(ends.select("src", F.col("_ends.dst").alias("nexts")), "next-lists")


def subgraph_summary(seeds: DataFrame, edges: DataFrame, types: DataFrame, depth: int = 2) -> DataFrame:
    """``summarise`` of the subgraphs that ``expand`` gives, counted without their rows.

    Edges travel as one list of each node. What the nodes with more than HUB_STEPS edges lead to in the last step is one set for all seeds that
    reach the same ones of them; the seeds count it and keep rows of the other nodes only. Edges are counted by levels: those that leave a
    level are its nodes' degrees, those within a level are looked for among edges whose ends both lie in somebody's level.
    """
    depth = max(1, min(depth, 3))
    lists = next_lists(edges)
    pairs = lists.select("src", F.explode("nexts").alias("dst"))
    ins = stored(pairs.groupBy(F.col("dst").alias("node")).agg(F.count_if(F.col("src") != F.col("dst")).alias("n")), "ins")
    outs = lists.select(F.col("src").alias("node"), F.size("nexts").cast("long").alias("n"))
    wide = stored(outs.unionByName(ins).groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") > HUB_STEPS), "wide")

    def met(rows: DataFrame) -> DataFrame:
        """``seed, nexts``: lists of what the nodes lead to; edges are only turned round for nodes that are their second ends."""
        back = stored(rows.join(ins, "node", "left_semi").select("seed", "node"), "back")
        turned = pairs.where("src <> dst").join(back, F.col("dst") == F.col("node")).select("seed", F.array("src").alias("nexts"))
        return lists.join(rows, F.col("src") == F.col("node")).select("seed", "nexts").unionByName(turned)

    level = stored(seeds.where("seed IS NOT NULL").select("seed", F.col("seed").alias("node")).distinct(), "level")
    inner, levels = level, [level]
    for _ in range(depth - 1):
        level = stored(met(level).select("seed", F.explode("nexts").alias("node")).distinct().join(inner, ["seed", "node"], "left_anti"), "level")
        inner, levels = inner.unionByName(level), [*levels, level]

    # What wide nodes lead to, once for each set of them: one of its seeds stands for it.
    broad = stored(level.join(wide, "node"), "broad")
    sets = stored(broad.groupBy("seed").agg(F.array_sort(F.collect_set("node")).alias("_set"), F.sum("n").alias("steps")), "sets")
    named = stored(sets.groupBy("_set").agg(F.min("seed").alias("rep")), "named")
    sets = stored(sets.join(named, "_set").select("seed", "rep", "steps"), "sets")
    first = broad.join(named.select(F.col("rep").alias("seed")), "seed", "left_semi").select("seed", "node")
    shared = stored(met(stored(first, "first")).select(F.col("seed").alias("rep"), F.explode("nexts").alias("node")).distinct(), "shared")

    # The rest by seed: nodes that are known, and what narrow nodes lead to. Seeds with many of these are dealt by what is led to.
    narrow = stored(level.join(wide, "node", "left_anti"), "narrow")
    rest = inner.select("seed", F.array("node").alias("nexts"), F.lit(True).alias("known")).unionByName(met(narrow).withColumn("known", F.lit(False)))
    rest = rest.join(F.broadcast(heavy(narrow, "seed").withColumn("_hub", F.lit(True))), "seed", "left")
    rest = rest.withColumn("_part", F.explode(F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))))
    own_part = F.filter("nexts", lambda x: F.pmod(F.xxhash64(x), F.lit(PARTS)) == F.col("_part"))
    rest = rest.select("seed", "_part", "known", F.when(F.col("_hub"), own_part).otherwise(F.col("nexts")).alias("nexts")).repartition("seed", "_part")
    reached = rest.select("seed", "_part", "known", F.explode("nexts").alias("node")).groupBy("seed", "_part", "node").agg(F.bool_or("known").alias("known"), F.count_if(~F.col("known")).alias("steps"))
    reached = stored(reached.drop("_part").join(sets.select("seed", "rep"), "seed", "left"), "reached")

    known = types.groupBy("tag").agg(F.collect_set(F.coalesce("node_type", F.lit("Unknown"))).alias("_types"))

    def typed(rows: DataFrame, key: str, n: str, names: str) -> DataFrame:
        told = rows.join(known, rows["node"] == known["tag"], "left").select(key, F.coalesce("_types", F.array(F.lit("Unknown"))).alias("_types"))
        return told.groupBy(key, "_types").agg(F.count("*").alias("_n")).groupBy(key).agg(F.sum("_n").alias(n), F.array_distinct(F.flatten(F.collect_list("_types"))).alias(names))

    fresh = typed(reached.join(shared, ["rep", "node"], "left_anti"), "seed", "_n", "_names")
    both = sets.select("seed", "rep").join(typed(shared, "rep", "_m", "_more"), "rep").drop("rep")
    empty = F.array().cast("array<string>")
    nodes = fresh.join(both, "seed", "full").select("seed", (F.coalesce("_n", F.lit(0)) + F.coalesce("_m", F.lit(0))).alias("n_nodes"), F.array_sort(F.array_union(F.coalesce("_names", empty), F.coalesce("_more", empty))).alias("node_types"))

    def within(nodes: DataFrame, rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``seed, loop`` of the edges between two of a seed's ``rows``; these are asked for at such edges' ends, which lie in ``nodes``."""
        ends = stored(nodes.select("node").distinct(), "ends")
        second = stored(ends.join(ins, "node", "left_semi"), "second").withColumnRenamed("node", "dst")
        one = ends.withColumnRenamed("node", "src")
        if second.count() < ends.count():
            thin = pairs.join(second, "dst", "left_semi").join(one, "src", "left_semi")
        else:
            thin = lists.join(one, "src", "left_semi").select("src", F.explode("nexts").alias("dst")).join(second, "dst", "left_semi")
        thin = stored(thin.select("src", "dst"), "thin")
        if thin.isEmpty():
            return sets.limit(0).select("seed", F.lit(False).alias("loop"))
        at = stored(rows(thin.select(F.explode(F.array("src", "dst")).alias("node")).distinct()), "at")
        met_twice = at.withColumnRenamed("node", "src").join(thin, "src").join(at.withColumnRenamed("node", "dst"), ["seed", "dst"], "left_semi")
        return met_twice.select("seed", (F.col("src") == F.col("dst")).alias("loop"))

    def outer(ends: DataFrame) -> DataFrame:
        more = shared.join(ends, "node", "left_semi").join(sets, "rep").select("seed", "node")
        own = reached.where("NOT known").join(ends, "node", "left_semi").select("seed", "node")
        return own.unionByName(more).distinct().join(inner, ["seed", "node"], "left_anti")

    # Edges from level to level are the degrees of every second level, the last but one first, less what lies within these levels.
    counts = reached.select("seed", F.col("steps").alias("n")).unionByName(sets.select("seed", F.col("steps").alias("n")))
    for k, own in enumerate(levels):
        odd = (depth - k) % 2
        if odd and k < depth - 1:
            counts = counts.unionByName(met(own).select("seed", F.size("nexts").cast("long").alias("n")))
        lie = within(own, lambda ends, own=own: own.join(ends, "node", "left_semi").select("seed", "node"))
        counts = counts.unionByName(lie.select("seed", (F.when(F.col("loop"), 0).otherwise(-1) if odd else F.lit(1)).cast("long").alias("n")))
    last = within(reached.where("NOT known").select("node").unionByName(shared.select("node")), outer)
    counts = counts.unionByName(last.select("seed", F.lit(1).cast("long").alias("n"))).groupBy("seed").agg(F.sum("n").alias("n_edges"))
    lost = seeds.where("seed IS NULL").distinct().select("seed", F.lit(0).cast("long").alias("n_nodes"), F.array(F.lit("Unknown")).alias("node_types"), F.lit(0).cast("long").alias("n_edges"))
    return nodes.join(counts, "seed", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0))).unionByName(lost)


def relations_of(edges: DataFrame) -> DataFrame:
    """``tag, relation, other, direction`` for both ends of each edge, self-loops left out."""
    proper = edges.where("src <> dst")
    out = proper.select(F.col("src").alias("tag"), "relation", F.col("dst").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(proper.select(F.col("dst").alias("tag"), "relation", F.col("src").alias("other"), F.lit("in").alias("direction")))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges that touch each node, self-loops left out."""
    proper = edges.where("src <> dst")
    return proper.select(F.col("src").alias("tag")).unionByName(proper.select(F.col("dst").alias("tag"))).groupBy("tag").agg(F.count("*").alias("degree"))

"""The graph kept between sessions: triples with their evidence, and entities, each of which a batch joins without a re-read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import numeric_id, triple_key
from graphloom.operators.entities import entity_keys, merge_entities, row_mark
from graphloom.operators.kgc import assert_disjoint, exclude_taxa, split_triples
from graphloom.sources.kg import ENTITIES, EVIDENCE, TRIPLE
from graphloom.sources.runs import RunStore, Table
from graphloom.sources.written import scope, stash


class TripleStore:
    """Triples, and evidence that is unique over all its columns (nulls are equal), hashed by digests of their rows.

    A batch's rows are digested and shuffled to the stored buckets; what is stored is read there, its digests alone.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark = spark
        self.store = RunStore(spark, folder, {"kg": Table(f"{TRIPLE}, triple_mark string", "triple_mark"), "evidence": Table(f"{EVIDENCE}, row_mark string", "row_mark")}, buckets)

    def append(self, batch: str, new: DataFrame) -> bool:
        """Add what a batch of evidence has that is not stored. Missing columns are null; other ones are ignored.

        A batch that was added before changes nothing and returns False, also when its rows are others.
        """
        if batch in self.store.listing.batches:
            return False
        columns = self.spark.createDataFrame([], EVIDENCE).columns
        keyed = new.withColumn("triple", triple_key(F.col("head"), F.col("relation"), F.col("tail")))
        full = self.spark.createDataFrame([], EVIDENCE).unionByName(keyed.select(*(c for c in keyed.columns if c in columns)), allowMissingColumns=True)
        with scope(self.spark):
            full = stash(full, "batch")
            self.store.fit(full.count())
            fresh = self.store.absent("evidence", full.withColumn("row_mark", row_mark(columns)))
            # Made distinct before they are marked: most of a batch's evidence is of triples that it has already.
            triples = full.select("head", "relation", "tail").distinct().withColumn("triple_mark", row_mark(["head", "relation", "tail"]))
            return self.store.commit(batch, {"kg": self.store.absent("kg", triples), "evidence": fresh})

    def kg(self) -> DataFrame:
        return self.store.read("kg").drop("triple_mark")

    def evidence(self) -> DataFrame:
        return self.store.read("evidence").drop("row_mark")


class EntityStore:
    """Entities that are merged by common keys as batches of candidates arrive.

    ``keys`` tells which entity has a key. A batch looks up its own keys there, gets the entities that it meets, merges
    these with its candidates, and writes them anew; no other entity is read or written. As a key has one entity, all
    that a batch can join are those and its own candidates. Ids are never used twice.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark = spark
        tables = {
            "keys": Table("key string, entity_id string, version long", "key", "version"),
            "entities": Table(f"{ENTITIES}, alive boolean, reason string, version long", "entity_id", "version"),
            "mapping": Table("old_id string, new_id string, version long", "old_id"),
        }
        self.store = RunStore(spark, folder, tables, buckets)

    def append(self, batch: str, candidates: DataFrame) -> bool:
        """Merge a batch of candidates (the columns of entities but the id); a batch that was merged before changes nothing."""
        listing = self.store.listing
        if batch in listing.batches:
            return False
        version, last = F.lit(len(listing.batches)).cast("long"), listing.numbers.get("last", 0)
        with scope(self.spark):
            new = stash(candidates.select("type", "name", "synonyms", "other_db_ids", "part_id"), "candidates")
            asked = new.select(F.explode(entity_keys(F.col("type"), F.col("other_db_ids"), F.col("part_id"))).alias("key")).distinct()
            owners = stash(self.store.held("keys", asked).select("key", "entity_id"), "owners")
            touched = self.store.held("entities", owners.select("entity_id").distinct()).where("alive")
            touched = stash(touched.select(*self.spark.createDataFrame([], ENTITIES).columns), "touched")
            merged, retired, mapping = merge_entities(touched, new, last)
            merged = stash(merged, "merged")
            top = merged.agg(F.max(numeric_id(F.col("entity_id")))).first()[0] or 0
            keyed = merged.select(F.explode(entity_keys(F.col("type"), F.col("other_db_ids"), F.col("part_id"))).alias("key"), "entity_id").distinct()
            none = F.lit(None).cast("string")
            gone = retired.select(*touched.columns, F.lit(False).alias("alive"), "reason", version.alias("version"))
            changed = merged.select(*touched.columns, F.lit(True).alias("alive"), none.alias("reason"), version.alias("version")).unionByName(gone)
            # What the batch asked for and still has its entity stays as it is; the other keys of what it met are few.
            rows = {"keys": keyed.join(owners, ["key", "entity_id"], "left_anti").withColumn("version", version), "entities": changed, "mapping": mapping.withColumn("version", version)}
            return self.store.commit(batch, rows, {"last": max(last, int(top))})

    def entities(self) -> DataFrame:
        return self.store.read("entities").where("alive").drop("alive", "reason", "version")

    def retired(self) -> DataFrame:
        return self.store.read("entities").where("not alive").drop("alive", "version")

    def mapping(self) -> DataFrame:
        """(old_id, new_id) of all entities that became part of another; the other may have gone the same way later."""
        return self.store.read("mapping").select("old_id", "new_id")


class SplitLedger:
    """Which triples are for training, validation and test, for good: a triple that was dealt once stays where it is.

    As the graph grows, only triples that the ledger does not hold are dealt; train is what is in neither hold-out.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.store = RunStore(spark, folder, {"dealt": Table(f"{TRIPLE}, split string, triple_mark string", "triple_mark")}, buckets)

    def deal(self, batch: str, triples: DataFrame, train: float = 0.7, val: float = 0.15, seed: str = "42") -> bool:
        """Deal the triples that are new, in pseudo-random order: whole parts of their count for train and val, the rest test.

        A batch that was dealt before changes nothing.
        """
        if batch in self.store.listing.batches:
            return False
        with scope(self.store.spark):
            marked = triples.select("head", "relation", "tail").withColumn("triple_mark", row_mark(["head", "relation", "tail"]))
            fresh = stash(self.store.absent("dealt", marked), "fresh")
            return self.store.commit(batch, {"dealt": split_triples(fresh, train, val, seed)})

    def splits(self) -> DataFrame:
        return self.store.read("dealt").drop("triple_mark")

    def training_set(self, parts: DataFrame, others: DataFrame, taxa: DataFrame) -> DataFrame:
        """Training triples: those dealt to train, part-level ones (``parts``) without the taxa of held-out heads, and all
        ``others`` (of other relations). ``taxa`` has (entity_id, tax_id). It shares no triple with a hold-out, or this fails."""
        triple = ["head", "relation", "tail"]
        dealt = self.splits()
        held = dealt.where("split <> 'train'").select(*triple)
        train = dealt.where("split = 'train'").select(*triple).unionByName(exclude_taxa(parts, held, taxa).select(*triple)).unionByName(others.select(*triple)).distinct()
        assert_disjoint(train, held)
        return train


class SourceSketches:
    """Sketches of the sets of keys (triples, papers) of each source, kept up by batches alone.

    A batch adds a sketch for each source and part; keys are dealt to ``parts`` by hash, which are settled by the first batch.
    Sets are united, intersected and subtracted as sketches, part by part, and counts added up. Sets of up to
    2 ** ``log_entries`` keys a part are exact; counts of larger ones are off by 1 / sqrt(2 ** ``log_entries``) of the
    union of all that takes part, as a rule, and by less with more parts.
    """

    def __init__(self, spark: SparkSession, folder: str, log_entries: int = 14, buckets: int | None = None, parts: int = 1):
        self.log_entries = log_entries
        self.store = RunStore(spark, folder, {"sketches": Table("source string, part long, sketch binary", "source")}, buckets)
        self.parts = self.store.listing.numbers.get("parts", max(1, parts))

    def update(self, batch: str, rows: DataFrame, source: str = "source", key: list[str] = ("head", "relation", "tail")) -> bool:
        """Add the keys of a batch's rows (those without a source or key do not count); once."""
        whole = rows.where(" and ".join(f"{c} is not null" for c in (source, *key)))
        mark = F.to_json(F.struct(*key)) if len(key) > 1 else F.col(key[0]).cast("string")
        dealt = whole.select(F.col(source).alias("source"), mark.alias("mark")).withColumn("part", F.pmod(F.xxhash64("mark"), F.lit(self.parts)))
        return self.store.commit(batch, {"sketches": dealt.groupBy("source", "part").agg(F.theta_sketch_agg("mark", F.lit(self.log_entries)).alias("sketch"))}, {"parts": self.parts})

    def sources(self) -> DataFrame:
        """(source, part, sketch): one for each source and part, of all batches."""
        return self.store.read("sketches").groupBy("source", "part").agg(F.theta_union_agg("sketch", F.lit(self.log_entries)).alias("sketch"))

    def counts(self) -> DataFrame:
        """(source, n): the distinct keys of each source, about."""
        return self.sources().groupBy("source").agg(F.sum(F.theta_sketch_estimate("sketch")).alias("n"))

    def regions(self, names: list[str]) -> DataFrame:
        """(mask, n): how many keys are in exactly these of the named sources, about; bit k stands for the k-th.

        A chain of intersections and differences of sketches for each of the 2 ** names - 1 masks; a source without a
        sketch is empty.
        """
        own = self.sources().where(F.col("source").isin(names))
        # A part of zeros, so that each mask has a row where no source has any.
        blank = self.store.spark.range(1).select(F.lit("").alias("source"), F.lit(-1).cast("long").alias("part"), F.lit(None).cast("binary").alias("sketch"))
        empty = own.unionByName(blank).groupBy("part").agg(*(F.max(F.when(F.col("source") == n, F.col("sketch"))).alias(f"s{k}") for k, n in enumerate(names)))
        out = []
        for mask in range(1, 1 << len(names)):
            chain, absent = None, F.lit(False)
            for k in range(len(names)):
                if mask >> k & 1:
                    absent = absent | F.col(f"s{k}").isNull()
                    chain = F.col(f"s{k}") if chain is None else F.theta_intersection(chain, F.col(f"s{k}"))
            for k in range(len(names)):
                if not mask >> k & 1:
                    chain = F.when(F.col(f"s{k}").isNull(), chain).otherwise(F.theta_difference(chain, F.col(f"s{k}")))
            out.append(F.struct(F.lit(mask).alias("mask"), F.when(absent, F.lit(0)).otherwise(F.theta_sketch_estimate(chain)).cast("long").alias("n")))
        return empty.select(F.explode(F.array(*out)).alias("r")).groupBy("r.mask").agg(F.sum("r.n").alias("n"))

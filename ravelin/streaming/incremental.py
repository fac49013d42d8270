"""Incremental upkeep of a corpus: an event reads and writes what its rows touch, not what is stored.

What is kept, each as a ``Shelf`` (a keyed table in buckets, of which an event reads and rewrites only those it touches):

* ``texts`` by text hash: origin and mark of every passage, for copies;
* ``groups`` by (subject, source): the decided passages without their texts;
* ``strong`` by (subject, source): the strongest statement of each group;
* ``entities`` by entity: the strongest statements again, one row per entity, for candidate pairs;
* ``pairs`` by first id, ``replaced`` by id: pairs judged so far and what they replaced;
* ``boards`` by subject: the best live statements in order, at most ``BOARD`` of them, and whether these are all;
* ``subjects`` by subject: counters and current statement, which is the snapshot.

The results are those of marking, pairing and consolidating everything again. Three steps need care for that. A new passage can become
the first of its text, and then older passages change their marks: some become copies, some stop being copies. A group whose strongest
statement became a copy is ranked again from its own passages; all other groups only compare the stored one with what came. A board of
which every statement was replaced or marked is ranked again from the subject's passages, unless it held all of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import corpus
from ravelin.operators.ordering import top_per_key

BUCKETS = 64
BOARD = 64
COUNTS = ["passages", "independent", "sources", "flags_risk", "has_deadline", "superseded", "contradictions"]


class Shelf:
    """A keyed table in buckets. A version writes the buckets it touches; a small table per version says where each bucket's latest is."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str, buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.schema, self.buckets = spark, root, keys, schema, buckets
        self.reads: list[tuple[int, int]] = []

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folder(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def places(self, version: int) -> dict[int, int]:
        """Bucket to version as of the version before ``version``: one small file, at most ``buckets`` entries."""
        for earlier in range(version - 1, -1, -1):
            path, files = self._folder(f"{self.root}/places/{earlier}.json")
            if files.exists(path):
                stream = files.open(path)
                found = json.loads(stream.readUTF())
                stream.close()
                return {int(b): v for b, v in found.items()}
        return {}

    def _place(self, places: dict[int, int], version: int) -> None:
        path, files = self._folder(f"{self.root}/places/{version}.json")
        stream = files.create(path, True)
        stream.writeUTF(json.dumps(places))
        stream.close()

    def _load(self, places: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/rows/version={v}/bucket={b}" for b, v in places.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, *keyed: DataFrame) -> list[int]:
        """Buckets of the keys of some tables: at most ``buckets`` numbers."""
        keys = reduce(DataFrame.unionByName, [k.select(*self.keys) for k in keyed])
        return [r["bucket"] for r in keys.select(self.bucket().alias("bucket")).distinct().collect()]

    def _written(self, path: str) -> set[int]:
        folder, files = self._folder(path)
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return {int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")}

    def read(self, buckets: list[int], version: int) -> DataFrame:
        """Rows of some buckets as they were before ``version``."""
        places = self.places(version)
        self.reads.append((len([b for b in buckets if b in places]), self.buckets))
        return self._load({b: places[b] for b in buckets if b in places})

    def whole(self, version: int) -> DataFrame:
        """All rows as of the end of ``version``."""
        return self._load(self.places(version + 1))

    def write(self, rows: DataFrame, buckets: list[int], version: int) -> DataFrame:
        """New content of the touched buckets; those left without rows are dropped."""
        path = f"{self.root}/rows/version={version}"
        cut = rows.select(*_names(self.schema), self.bucket().alias("bucket")).repartition(max(1, len(buckets)), "bucket")
        cut.write.mode("overwrite").partitionBy("bucket").parquet(path)
        there = self._written(path)
        places = {b: v for b, v in self.places(version).items() if b not in buckets} | {b: version for b in there}
        self._place(places, version)
        return self._load({b: version for b in there})


PASSAGE = "id {id}, source_id string, attachment_of string, path string, subject string, nature string, kind string, authority double, date string, flags_risk double, has_deadline double, sha256 string, n_text int"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


class IncrementalCorpus:
    """Corpus of decided passages (``PASSAGE`` columns and ``found``, their entities); ``judge`` adds contradicts and supersedes to pairs."""

    def __init__(self, spark: SparkSession, root: str, judge: Callable[[DataFrame], DataFrame], id_type: str = "long", buckets: int = BUCKETS):
        self.spark, self.root, self.judge = spark, root, judge
        passage = PASSAGE.format(id=id_type)
        full = f"{passage}, found array<string>, duplicate_of {id_type}"
        self.columns = _names(full)
        shelf = lambda name, keys, schema: Shelf(spark, f"{root}/{name}", keys, schema, buckets)
        self.texts = shelf("texts", ["sha256"], f"id {id_type}, source_id string, attachment_of string, path string, subject string, n_text int, sha256 string, duplicate_of {id_type}")
        self.groups = shelf("groups", ["subject", "source_id"], full)
        self.strong = shelf("strong", ["subject", "source_id"], full)
        self.entities = shelf("entities", ["entity"], f"entity string, {full}")
        self.pairs = shelf("pairs", ["a"], f"a {id_type}, b {id_type}, subject string, contradicts double, supersedes double")
        self.replaced = shelf("replaced", ["id"], f"id {id_type}, by {id_type}")
        self.boards = shelf("boards", ["subject"], f"{full}, whole boolean")
        self.subjects = shelf("subjects", ["subject"], f"subject string, current_id {id_type}, " + ", ".join(f"{c} long" for c in COUNTS))

    def _kept(self, df: DataFrame, name: str, version: int) -> DataFrame:
        """A step's result, written once under its version."""
        path = f"{self.root}/steps/{name}/version={version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def on_event(self, batch: DataFrame, version: int) -> None:
        """Take in new passages; the diff of the snapshot goes to ``diffs/version=<n>``. Running a version again gives the same files."""
        if batch.isEmpty():
            return
        new = self._kept(batch.select(*self.columns[:-1]), "new", version)
        new, moved = self._marked(new, version)
        groups, moved = self._grouped(new, moved, version)
        changed, around = self._strongest(groups, new, moved, version)
        fresh = self._paired(changed, around, version)
        self._consolidated(groups, new, moved, around, fresh, version)

    def _marked(self, new: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
        """New passages with their marks, and (id, subject, source_id, was, duplicate_of) of older ones whose mark changed."""
        buckets = self.texts.touched(new)
        stored = self.texts.read(buckets, version)
        known = stored.join(new.select("sha256").distinct(), "sha256", "left_semi")
        columns = _names(self.texts.schema)
        rows = known.withColumn("was", F.col("duplicate_of")).withColumn("old", F.lit(True)).drop("duplicate_of").unionByName(
            new.select(*columns[:-1]).withColumn("old", F.lit(False)), allowMissingColumns=True)
        marked = self._kept(rows.join(corpus.text_copies(rows), "id", "left"), "marked", version)
        self.texts.write(_without(stored, new, ["sha256"]).unionByName(marked.select(*columns)), buckets, version)
        moved = marked.where("old").where(~F.col("was").eqNullSafe(F.col("duplicate_of"))).select("id", "subject", "source_id", "was", "duplicate_of")
        marks = marked.where("NOT old").select("id", "duplicate_of")
        return self._kept(new.join(marks, "id", "left"), "new-marked", version), self._kept(moved, "moved", version)

    def _grouped(self, new: DataFrame, moved: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
        """The touched buckets of groups after the event, and the moved passages with all their columns."""
        buckets = self.groups.touched(new, moved)
        stored = self.groups.read(buckets, version)
        marks = moved.select("id", "was", F.col("duplicate_of").alias("now"), F.lit(True).alias("hit"))
        joined = stored.join(marks, "id", "left").withColumn("duplicate_of", F.when(F.col("hit"), F.col("now")).otherwise(F.col("duplicate_of")))
        joined = self._kept(joined, "groups", version)
        # groups that had no passage before this event
        first = new.where(F.col("subject") != "noise").select("subject", "source_id").distinct().join(stored.select("subject", "source_id").distinct(), ["subject", "source_id"], "left_anti")
        self._kept(first.groupBy("subject").agg(F.count(F.lit(1)).alias("sources")), "sources", version)
        rows = self.groups.write(joined.select(*self.columns).unionByName(new.select(*self.columns)), buckets, version)
        return rows, joined.where("hit").select(*self.columns, "was")

    def _strongest(self, groups: DataFrame, new: DataFrame, moved: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
        """Strongest statements that changed, and all that share an entity with one of them."""
        key = ["subject", "source_id"]
        keys = self._kept(new.select(*key).union(moved.select(*key)).distinct(), "keys", version)
        buckets = self.strong.touched(keys)
        stored = self.strong.read(buckets, version)
        before = stored.join(keys, key, "left_semi")
        copied = before.join(moved.where("duplicate_of IS NOT NULL").select("id"), "id", "left_semi").select(*key)
        again = groups.join(copied, key, "left_semi").select(*self.columns)
        freed = moved.where("duplicate_of IS NULL").select(*self.columns)
        compared = before.select(*self.columns).unionByName(new.select(*self.columns)).unionByName(freed)
        contenders = _without(compared, copied, key).unionByName(again)
        best = self._kept(corpus.strongest_per_source(corpus.pair_statements(contenders)).select(*self.columns), "strong", version)
        self.strong.write(_without(stored, keys, key).unionByName(best), buckets, version)
        ids = before.select("id")
        changed = self._kept(best.join(ids, "id", "left_anti"), "changed", version)
        gone = self._kept(before.join(best.select("id"), "id", "left_anti").select(*self.columns), "gone", version)
        spread = lambda df: df.withColumn("entity", F.explode("found"))
        buckets = self.entities.touched(spread(changed), spread(gone))
        stored = self.entities.read(buckets, version)
        rows = self.entities.write(_without(stored, gone, ["id"]).unionByName(spread(changed)), buckets, version)
        met = rows.join(spread(changed).select("entity").distinct(), "entity", "left_semi").drop("entity").dropDuplicates(["id"])
        # a strongest statement without entities is in no pair, but it may still be one that changed
        return changed, self._kept(met.select(*self.columns), "around", version)

    def _paired(self, changed: DataFrame, around: DataFrame, version: int) -> DataFrame:
        """New pairs, judged."""
        found = self._kept(corpus.pairs_touching(changed, around), "candidates", version)
        buckets = self.pairs.touched(found)
        stored = self.pairs.read(buckets, version)
        fresh = self._kept(self.judge(corpus.fresh_pairs(found, stored)), "fresh", version)
        self.pairs.write(stored.unionByName(fresh), buckets, version)
        return fresh

    def _consolidated(self, groups: DataFrame, new: DataFrame, moved: DataFrame, around: DataFrame, fresh: DataFrame, version: int) -> None:
        replaced = self._kept(corpus.replaced_by(corpus.supersessions(fresh, around)).distinct(), "replaced", version)
        buckets = self.replaced.touched(replaced, moved, new)
        stored = self.replaced.read(buckets, version)
        earlier = stored.select("id").distinct().withColumn("gone_before", F.lit(True))
        after = self.replaced.write(stored.unionByName(replaced), buckets, version).select("id").distinct().withColumn("gone_now", F.lit(True))
        # passages whose part in the state may have changed: new ones, moved ones, replaced ones
        rows = new.select(*self.columns).withColumns({"fresh": F.lit(True), "was": F.lit(None).cast(new.schema["id"].dataType)})
        rows = rows.unionByName(moved.withColumn("fresh", F.lit(False)))
        hit = around.join(replaced.select("id").distinct(), "id", "left_semi").join(rows.select("id"), "id", "left_anti")
        rows = rows.unionByName(hit.select(*self.columns).withColumns({"fresh": F.lit(False), "was": F.col("duplicate_of")}))
        rows = rows.join(earlier, "id", "left").join(after, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("gone_before", "gone_now")})
        states = rows.withColumn("own_before", ~F.col("fresh") & F.col("was").isNull()).withColumn("own_now", F.col("duplicate_of").isNull())
        natures = [n for n in corpus.STATE_NATURE_RANK if n not in ("information", "noise")]
        states_it = F.col("nature").isin(natures) & (F.col("authority") >= 1) & (F.col("subject") != "noise")
        states = self._kept(states.withColumn("states_it", states_it), "states", version)
        change = lambda before, now: (now.cast("int") - before.cast("int"))
        flagged = lambda c: F.coalesce(F.col(c) >= corpus.YES, F.lit(False))
        own_before, own_now, can = F.col("own_before"), F.col("own_now"), F.col("states_it")
        deltas = states.where(F.col("subject") != "noise").groupBy("subject").agg(
            F.count_if("fresh").alias("passages"), F.sum(change(own_before, own_now)).alias("independent"),
            F.sum(change(own_before & flagged("flags_risk"), own_now & flagged("flags_risk"))).alias("flags_risk"),
            F.sum(change(own_before & flagged("has_deadline"), own_now & flagged("has_deadline"))).alias("has_deadline"),
            F.sum(change(can & own_before & F.col("gone_before"), can & own_now & F.col("gone_now"))).alias("superseded"),
        )
        sources = self.spark.read.schema("subject string, sources long").parquet(f"{self.root}/steps/sources/version={version}")
        fights = fresh.where(F.col("contradicts") >= corpus.YES).withColumn("subject", F.explode(F.split("subject", r"\|"))).groupBy("subject").agg(F.count(F.lit(1)).alias("contradictions"))
        deltas = self._kept(deltas.join(sources, "subject", "full").join(fights, "subject", "full").select("subject", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]), "deltas", version)
        first = self._ranked(groups, states, deltas, version)
        buckets = self.subjects.touched(deltas)
        stored = self.subjects.read(buckets, version)
        before = self._kept(stored.join(deltas.select("subject"), "subject", "left_semi"), "before", version)
        total = deltas.select("subject", *[F.col(c).alias(f"d_{c}") for c in COUNTS]).join(before.drop("current_id"), "subject", "left")
        total = total.select("subject", *[(F.coalesce(c, F.lit(0)) + F.col(f"d_{c}")).alias(c) for c in COUNTS])
        now = self._kept(total.join(first, "subject", "left").select("subject", "current_id", *COUNTS), "now", version)
        self.subjects.write(_without(stored, now, ["subject"]).unionByName(now), buckets, version)
        corpus.diff_snapshots(before, now).write.mode("overwrite").parquet(f"{self.root}/diffs/version={version}")

    def _ranked(self, groups: DataFrame, states: DataFrame, deltas: DataFrame, version: int) -> DataFrame:
        """(subject, current_id) of the touched subjects."""
        buckets = self.boards.touched(deltas)
        stored = self.boards.read(buckets, version)
        held = stored.join(deltas.select("subject"), "subject", "left_semi")
        live = F.col("own_now") & F.col("states_it") & ~F.col("gone_now")
        out = states.where(~live).select("id")
        joining = states.where(live).select(*self.columns).join(held.select("id"), "id", "left_anti")
        facts = held.groupBy("subject").agg(F.bool_and("whole").alias("whole"))
        union = held.drop("whole").withColumn("held", F.lit(True)).unionByName(joining.withColumn("held", F.lit(False)))
        union = union.join(out.withColumn("out", F.lit(True)), "id", "left")
        ranked = top_per_key(union, ["subject"], corpus.rank_order(union), 2_000_000_000, "place")
        last = ranked.where("held").groupBy("subject").agg(F.max("place").alias("last"))
        ranked = ranked.join(facts, "subject", "left").join(last, "subject", "left").withColumn("whole", F.coalesce("whole", F.lit(True)))
        # beyond the last one of a board that isn't whole there may be better ones than those that came
        ranked = ranked.where("out IS NULL AND (whole OR place <= last)")
        ranked = self._kept(ranked.select(*self.columns, "whole"), "ranked", version)
        emptied = facts.where("NOT whole").join(ranked.select("subject").distinct(), "subject", "left_anti").select("subject")
        emptied = self._kept(emptied, "emptied", version)
        if not emptied.isEmpty():
            rows = corpus.subject_statements(self.groups.whole(version).join(emptied, "subject", "left_semi"))
            gone = self.replaced.whole(version).select("id").distinct()
            ranked = ranked.unionByName(rows.join(gone, "id", "left_anti").withColumn("whole", F.lit(True)))
        kept = top_per_key(ranked, ["subject"], corpus.rank_order(ranked), BOARD + 1, "place")
        over = kept.where(F.col("place") > BOARD).select("subject", F.lit(True).alias("over"))
        kept = kept.where(F.col("place") <= BOARD).join(over, "subject", "left").withColumn("whole", F.col("whole") & F.col("over").isNull())
        kept = self._kept(kept.drop("over"), "boards", version)
        self.boards.write(_without(stored, deltas, ["subject"]).unionByName(kept.drop("place")), buckets, version)
        return kept.where("place = 1").select("subject", F.col("id").alias("current_id"))

    def snapshot(self, version: int) -> DataFrame:
        return self.subjects.whole(version)

    def diffs(self) -> DataFrame:
        path = f"{self.root}/diffs"
        return self.spark.read.option("basePath", path).parquet(path)

"""Jaccard join of word n-gram sets by prefix filters under several global token orders.

Under any one order of all tokens, two sets whose similarity is at least t share a
token among the first ``n - ceil(t n) + 1`` of each. The operator keeps three such
orders (three hash seeds):

1. Texts with equal sets become one class; only the classes go on.
2. *First order.* Every class posts its first tokens, and a few more. A token that few
   classes post gives their pairs. A token that many post (from a passage common to
   thousands of texts) moves to the end of the order; it only gives the pairs of its
   classes with its smallest class, which joins large groups of copies early.
3. *Other orders.* A pair goes on only if its sets also share a prefix token under the
   second and the third order, and if the parity bitmaps of the sets allow the
   overlap (each differing bit is a differing token).
4. Verification counts the common tokens of the whole sets.
5. *Completion.* A class that posted too few tokens besides the common ones is short of
   a prefix. Short classes take their next tokens in that order and look them up in
   all postings. Among themselves they are joined once more, rarest tokens first, with
   positions; pairs inside a cluster of step 4 can't change a component and are left out.

Every link that can join two components is verified: nothing is capped, and the limit
between few and many (`FEW`) only moves tokens in the order.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.names import free_name, ref
from .common import broadcast_ids, lists, map_texts, stage
from .components import components
from .kernels import batches, mix, shingle_sets

FEW = 32  # classes up to which a token's classes are paired with each other
MARGIN_SHARE, MARGIN = 0.02, 4  # tokens posted beyond the prefix, for those that turn out to be common
BITS = 1024
SEEDS = (np.uint64(0xA5A5_1234_9E37_79B9), np.uint64(0x5A5A_4321_7F4A_7C15))

_NODE = "doc_id long, n int, p int, hi long, lo long, prefix array<long>"
_SIGNATURE = "id long, n int, second array<int>, third array<int>, parity array<long>"


_TOKENS = "id long, n int, p int, posted int, tokens array<long>"


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def posted_length(n: int, percent: int) -> int:
    return min(n, prefix_length(n, percent) + MARGIN + int(MARGIN_SHARE * n))


def _sets(batch: pa.RecordBatch, n_words: int):
    """(document ids, shingle sets) of runs of the batch."""
    ids, texts = batch.column(0), batch.column(1).to_pylist()
    for begin, raws in batches(texts):
        yield ids.slice(begin, len(raws)), shingle_sets(raws, n_words)


def _nodes(batch: pa.RecordBatch, n_words: int, percent: int):
    for ids, sets in _sets(batch, n_words):
        n = [len(s) for s in sets]
        p = [min(k, prefix_length(k, percent)) for k in n]
        posted = [s[: posted_length(len(s), percent)].view(np.int64) for s in sets]
        hi, lo = _identity(sets)
        columns = [ids, pa.array(n, pa.int32()), pa.array(p, pa.int32()), pa.array(hi), pa.array(lo), lists(np.concatenate(posted), [len(x) for x in posted], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "p", "hi", "lo", "prefix"])


def _identity(sets) -> tuple[np.ndarray, np.ndarray]:
    """Two independent sums of mixed tokens name a set."""
    hi = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    return hi, np.array([mix(s ^ SEEDS[0]).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)


def _named(batch: pa.RecordBatch, n_words: int, names=("hi", "lo")):
    """The rows of a batch, id and text first, with the name of each text's set."""
    begin = 0
    for ids, sets in _sets(batch, n_words):
        hi, lo = _identity(sets)
        yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(ids)).columns, pa.array(hi), pa.array(lo)], [*batch.schema.names, *names])
        begin += len(ids)


def _signatures(batch: pa.RecordBatch, n_words: int, percent: int):
    """Prefix tokens under the other orders (32 bits of each) and parity bitmaps."""
    for ids, sets in _sets(batch, n_words):
        n = [len(s) for s in sets]
        p = [min(k, prefix_length(k, percent)) for k in n]
        other = []
        for seed in SEEDS:
            own = []
            for s, q in zip(sets, p):
                first = np.argpartition(mix(s ^ seed), q - 1)[:q] if 0 < q < len(s) else slice(None)
                own.append(s[first].astype(np.uint32).view(np.int32))
            other.append(lists(np.concatenate(own), [len(x) for x in own], pa.int32()))
        parity = [np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1).astype(np.uint8)).view(np.int64) for s in sets]
        columns = [ids, pa.array(n, pa.int32()), *other, lists(np.concatenate(parity), [BITS // 64] * len(sets), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n", "second", "third", "parity"])


def _whole_sets(batch: pa.RecordBatch, n_words: int):
    for ids, sets in _sets(batch, n_words):
        yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "tokens"])


def _all_tokens(batch: pa.RecordBatch, n_words: int, percent: int):
    for ids, sets in _sets(batch, n_words):
        n = [len(s) for s in sets]
        numbers = [[f(k, percent) for k in n] for f in (lambda k, _: k, prefix_length, posted_length)]
        tokens = lists(np.concatenate(sets).view(np.int64), n, pa.int64())
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int32()) for x in numbers], tokens], ["id", "n", "p", "posted", "tokens"])


def _overlap(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The common tokens of each pair."""
    both, union = [], []
    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both.append(len(np.intersect1d(x, y, assume_unique=True)))
        union.append(len(x) + len(y) - both[-1])
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(union, pa.int64())], ["u", "v", "shared", "union"])


def _sized(x: str, y: str, percent: int):
    """The smaller set is large enough beside the larger one."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


class Join:
    """One similarity join; the steps are methods so that tests can look at each."""

    def __init__(self, docs: DataFrame, percent: int = 80, n_words: int = 5, few: int = FEW):
        self.docs, self.percent, self.n_words, self.few = docs.select(F.col("doc_id").cast("long"), "text"), percent, n_words, few
        self.per_doc = stage(map_texts(self.docs, partial(_nodes, n_words=n_words, percent=percent), _NODE))
        known = self.per_doc.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
        self.classes = stage(known.groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")))
        # By id and set: an id that has two texts may stand for one class and be a copy in another.
        key = ["doc_id", "hi", "lo"]
        copies = known.join(self.classes.filter("copies > 1"), ["hi", "lo", "n"]).filter("doc_id <> id").select(*key).distinct()
        nodes = known.join(broadcast_ids(stage(copies)), key, "left_anti").withColumnRenamed("doc_id", "id")
        self.classes = self.classes.withColumn("least", F.col("id"))
        shared = stage(self.classes.groupBy("id").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("id"))
        self.renamed = not shared.isEmpty()
        if self.renamed:
            nodes = self._named_apart(nodes, shared)
        self.nodes = nodes

    def _named_apart(self, nodes: DataFrame, shared: DataFrame) -> DataFrame:
        """Classes whose smallest id is the same get numbers of their own, below all ids."""
        low = F.least(self.per_doc.agg(F.min("doc_id")).first()[0] * F.lit(1).cast("long"), F.lit(0).cast("long"))
        fresh = self.classes.join(broadcast_ids(shared), "id", "left_semi").select("hi", "lo", "id", (low - 1 - F.monotonically_increasing_id()).alias("name"))
        fresh = stage(fresh)
        renamed = self.classes.join(fresh.drop("id"), ["hi", "lo"], "left")
        self.classes = stage(renamed.withColumn("id", F.coalesce("name", "id")).drop("name"))
        named = partial(_named, n_words=self.n_words)
        own = self.docs.join(broadcast_ids(shared.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi")
        own = map_texts(own, named, "doc_id long, text string, hi long, lo long")
        own = own.join(fresh.withColumnRenamed("id", "doc_id"), ["doc_id", "hi", "lo"]).dropDuplicates(["name"]).select(F.col("name").alias("doc_id"), "text")
        rest = self.docs.join(broadcast_ids(shared.withColumnRenamed("id", "doc_id")), "doc_id", "left_anti")
        self.docs = rest.unionByName(stage(own))
        out = nodes.join(fresh, ["hi", "lo", "id"], "left").withColumn("id", F.coalesce("name", "id")).drop("name")
        return out.dropDuplicates(["id"]).select("id", "n", "p", "hi", "lo", "prefix")

    def postings(self) -> DataFrame:
        return self.nodes.select(F.explode("prefix").alias("token"), "id", "n")

    def shared(self) -> DataFrame:
        """Postings (token, id, n, df) of tokens that at least two classes posted; df classes did."""
        rows = self.postings()
        counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        return stage(rows.join(counts, "token"))

    def pairs_of_few(self, rows: DataFrame) -> DataFrame:
        members = rows.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("members"))
        left = members.select(F.explode("members").alias("x"), "members")
        later = F.filter("members", lambda y: (y["id"] > F.col("x.id")) & _sized(F.col("x.n"), y["n"], self.percent))
        return left.select(F.col("x.id").alias("u"), F.explode(later).alias("y")).select("u", F.col("y.id").alias("v"))

    def stars(self, rows: DataFrame) -> DataFrame:
        """Each class of a common token with the token's smallest class."""
        hubs = rows.groupBy("token").agg(F.min(F.struct("id", "n")).alias("hub"))
        joined = rows.join(hubs, "token").filter((F.col("id") != F.col("hub.id")) & _sized(F.col("n"), F.col("hub.n"), self.percent))
        return joined.select(F.col("hub.id").alias("u"), F.col("id").alias("v"))

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs that share prefix tokens under the other orders and whose bitmaps allow the overlap."""
        out = stage(pairs.groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one"))
        ends = stage(out.select(F.col("u").alias("doc_id")).union(out.select("v")).distinct())
        own = stage(map_texts(self.texts_of(ends), partial(_signatures, n_words=self.n_words, percent=self.percent), _SIGNATURE))
        for end in ("u", "v"):
            out = out.join(own.withColumnsRenamed({"id": end, **{c: f"{c}_{end}" for c in ("n", "second", "third", "parity")}}), end)
        differ = F.aggregate(F.zip_with("parity_u", "parity_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
        both = F.col("n_u") + F.col("n_v")
        keep = F.arrays_overlap("second_u", "second_v") & F.arrays_overlap("third_u", "third_v")
        keep &= (both - differ) * (100 + self.percent) >= both * 2 * self.percent
        return stage(out.filter(keep).select("u", "v"))

    def texts_of(self, ids: DataFrame) -> DataFrame:
        return self.docs.join(broadcast_ids(ids), "doc_id", "left_semi")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(u, v, shared, union) of the pairs that are similar enough."""
        ends = stage(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct())
        sets = map_texts(self.texts_of(ends), partial(_whole_sets, n_words=self.n_words), "id long, tokens binary")
        sets = stage(sets)
        rows = pairs.join(sets.withColumnsRenamed({"id": "u", "tokens": "x"}), "u").join(sets.withColumnsRenamed({"id": "v", "tokens": "y"}), "v")
        counted = map_texts(rows.select("u", "v", "x", "y"), _overlap, "u long, v long, shared long, union long")
        return stage(counted.filter(F.col("shared") * 100 >= F.col("union") * self.percent).distinct())

    def links(self) -> DataFrame:
        """Verified links between class representatives: enough of them to join every component."""
        rows = self.shared()
        common = rows.filter(F.col("df") > self.few)
        found = self.verified(self.filtered(self.pairs_of_few(rows.filter(F.col("df") <= self.few)).union(self.stars(common))))
        posted = self.nodes.select("id", "p", F.size("prefix").alias("posted"))
        short = common.groupBy("id").agg(F.count(F.lit(1)).alias("hot")).join(posted, "id").filter("posted - hot < p")
        short = stage(short.select(F.col("id").alias("doc_id")))
        if short.isEmpty():
            return found
        whole = map_texts(self.texts_of(short), partial(_all_tokens, n_words=self.n_words, percent=self.percent), _TOKENS)
        whole = stage(whole.select("id", "n", "p", "posted", F.posexplode("tokens").alias("pos", "token")))
        pairs = self.later_pairs(whole, stage(common.select("token").distinct())).union(self.short_pairs(whole, found))
        return stage(found.union(self.verified(self.filtered(pairs))).distinct())

    def later_pairs(self, whole: DataFrame, common: DataFrame) -> DataFrame:
        """Short classes with all classes that posted one of their next tokens, common tokens left out."""
        turn = Window.partitionBy("id").orderBy("pos")
        rest = whole.join(broadcast_ids(common), "token", "left_anti").withColumn("turn", F.row_number().over(turn))
        rest = stage(rest.filter("turn <= p and pos >= posted").select("token", F.col("id").alias("u"), F.col("n").alias("n_u")))
        joined = self.postings().join(broadcast_ids(rest), "token").filter((F.col("u") != F.col("id")) & _sized(F.col("n"), F.col("n_u"), self.percent))
        return joined.select(F.least("u", "id").alias("u"), F.greatest("u", "id").alias("v"))

    def short_pairs(self, whole: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs of short classes in different clusters: prefixes by rising frequency among them, and positions.

        With the first common token at positions i and j, the overlap is at most
        ``min(n - i, n' - j)``. The pairs of one token leave out those inside its largest cluster.
        """
        counts = whole.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        rank = Window.partitionBy("id").orderBy("df", "token")
        rows = whole.join(counts, "token").withColumn("rank", F.row_number().over(rank)).filter("rank <= p and df > 1")
        cluster = components(found.select("u", "v"))
        rows = rows.select("token", "id", "n", (F.col("n") - F.col("rank") + 1).alias("left")).join(cluster, "id", "left")
        rows = stage(rows.select("token", "id", "n", "left", F.coalesce("component", "id").alias("c")))
        sizes = rows.groupBy("token", "c").agg(F.count(F.lit(1)).alias("size"))
        most = sizes.groupBy("token").agg(F.max_by("c", F.struct("size", "c")).alias("most"), F.count(F.lit(1)).alias("clusters"))
        rows = stage(rows.join(most.filter("clusters > 1"), "token").withColumn("main", F.expr("c = most")).drop("most", "clusters"))
        other = rows.select("token", *[F.col(x).alias(f"{x}_") for x in ("id", "n", "left", "c", "main")])
        joined = rows.filter("not main").join(other, "token").filter((F.col("c") != F.col("c_")) & (F.col("main_") | (F.col("id") < F.col("id_"))))
        enough = F.least("left", "left_") * (100 + self.percent) >= (F.col("n") + F.col("n_")) * self.percent
        joined = joined.filter(enough & _sized(F.col("n"), F.col("n_"), self.percent))
        return joined.select(F.least("id", "id_").alias("u"), F.greatest("id", "id_").alias("v"))

    def by_class(self) -> DataFrame:
        """(doc_id, n, hi, lo, component_id) of every document; hi and lo name its set."""
        found = components(self.links().select("u", "v"))
        of = self.classes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        if self.renamed:  # the smallest class need not be the one with the smallest id
            least = of.groupBy("component").agg(F.min("least").alias("component_id"))
            of = of.join(least, "component")
        else:
            of = of.withColumn("component_id", F.col("component"))
        own = self.per_doc.select("doc_id", "n", "hi", "lo")
        known = own.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0)).join(of.select("hi", "lo", "n", "component", "component_id"), ["hi", "lo", "n"])
        rest = own.filter(F.col("doc_id").isNull() | (F.col("n") == 0)).withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
        return known.unionByName(rest, allowMissingColumns=True)

    def membership(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every document."""
        return self.by_class().select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def ngram_components(docs: DataFrame, percent: int = 80, n_words: int = 5, few: int = FEW) -> DataFrame:
    """One row per document: set size and the smallest document its links reach.

    Needs ``doc_id`` and ``text``; further columns don't matter. Two documents link if
    ``100 |A & B| >= percent |A | B|`` for their sets of distinct ``n_words``-grams over
    words ``[^\\x20\\x09-\\x0D]+`` with A-Z folded; a text of fewer words is one shingle.
    Null, empty and wordless texts have an empty set and no links. Texts are linked, not ids: rows that
    share a ``doc_id`` are in one component only if their texts are. Rows without an id are returned with a null component and
    link nothing. An empty table gives an empty table. Tokens are 64-bit hashes.
    """
    return Join(docs, percent, n_words, few).membership()


def keep_one(docs: DataFrame, percent: int = 80, n_words: int = 5) -> DataFrame:
    """The documents without those that link to an earlier one: of each component one row stays, the one of its smallest id.

    Texts decide, not ids: of two rows that share an id but not a component both components keep a row. Rows without an
    id and texts without words all stay. Extra columns stay, whatever their names; an empty table gives none.
    """
    join = Join(docs, percent, n_words)
    found = stage(join.by_class())
    twice = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id")
    twice = stage(twice)
    if twice.isEmpty():
        drop = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
        return docs.join(broadcast_ids(stage(drop)), "doc_id", "left_anti").select(*[ref(c) for c in docs.columns])
    # One set of each component stands for it; ids that occur once need no look at their text.
    keepers = found.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "hi", "lo")).alias("k")).select("k.*")
    keepers = stage(keepers)
    once = found.join(twice, "doc_id", "left_anti").filter("component is not null").join(keepers, ["doc_id", "hi", "lo"], "left_anti").select("doc_id")
    single = docs.join(twice, "doc_id", "left_anti").join(broadcast_ids(stage(once)), "doc_id", "left_anti").select(*[ref(c) for c in docs.columns])
    hi, lo = (free_name(n, docs.columns) for n in ("set_hi", "set_lo"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.join(twice, "doc_id", "left_semi").select("doc_id", "text", *[ref(c) for c in others])
    schema = ", ".join([*["`" + f.name.replace("`", "``") + f"` {f.dataType.simpleString()}" for f in rows.schema.fields], f"{hi} long, {lo} long"])
    named = map_texts(rows, partial(_named, n_words=n_words, names=(hi, lo)), schema)
    wordless = found.filter("n = 0").select(F.col("hi").alias(hi), F.col("lo").alias(lo)).limit(1)  # all have one name
    kept = named.join(keepers.withColumnsRenamed({"hi": hi, "lo": lo}), ["doc_id", hi, lo], "left_semi").dropDuplicates(["doc_id", hi, lo])
    empty = named.join(wordless, [hi, lo], "left_semi")
    return single.unionByName(kept.unionByName(empty).select(*[ref(c) for c in docs.columns]))


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))

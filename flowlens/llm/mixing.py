"""Mixing sources to target weights, with DataFrame functions only.

The texts of a source, in a fixed pseudorandom order, form one stream of words that is cut into
blocks of equal length. Each source is given as many slots of the mix as its target asks for. A
keyed permutation places the slots of all sources on the mix, so the sources' counts in an output
shard are a multinomial draw, conditioned on the totals being exact. A second, per-source
permutation maps the slot numbers of a source to its block numbers; slots and blocks meet in a
join by block number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.shared import checked_lookup, join_lookup, written_table

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 12
CELL_ROWS = 20_000
SLOTS_PER_ROW = 4096


def permuted(x: Column, n: Column, *key: Column, inverse: bool = False) -> Column:
    """Image of x under a keyed permutation of 0 .. n-1 (swap-or-not rounds, any n), or what has x as its image."""

    def swap(at: Column, turn: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, turn), n) - at, n)
        chosen = F.xxhash64(*key, turn, F.greatest(at, partner), F.lit("swap"))
        return F.when(chosen < 0, partner).otherwise(at)

    ends = (F.lit(0), F.lit(ROUNDS - 1))
    turns = F.sequence(*(reversed(ends) if inverse else ends))
    return F.coalesce(F.aggregate(turns, x.cast("long"), swap), F.lit(0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Words that each source gives: ``share`` times all words dealt by weight, at most ``most`` times its own.

    What exceeds a source's limit is dealt again by weight among the others. Sources are taken by
    code point, null last, and weigh ``weights`` in turn. One row per source; the windows without
    partition see this table only.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))) + 1)
    ranked = totals.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The rate rises while sources are capped and falls afterwards, so its peak is the final rate.
    rated = ranked.withColumn("rate", left / open_weight).withColumn("rate", F.max("rate").over(everything))
    return rated.select(
        "source", "rank", "source_size", F.least("cap", F.col("rate") * F.col("weight")).alias("target")
    )


class Mix:
    """A mix of documents: who gives how much, the slots of the mix, and the documents behind them."""

    def __init__(
        self,
        docs: DataFrame,
        weights: tuple[int, ...] = (3, 1, 2),
        share: float = 1.5,
        most: float = 2.0,
        block_words: int = 128,
        shard_blocks: int = 8192,
        seed: int = 0,
        id_col: str = "doc_id",
        text_col: str = "text",
        source_col: str = "source",
    ):
        """
        Sizes are counts of words between ASCII white space; a null text has none. A null source is a
        source of its own. Rows without id and repeated rows count as documents of their own. Columns
        other than the three named are not read. An empty table gives an empty mix.
        """
        self.docs, self.text_col, self.id_col = docs, text_col, id_col
        self.block_words, self.shard_blocks, self.seed = block_words, shard_blocks, F.lit(seed)
        text = F.col(text_col).cast("string")
        self.sizes = written_table(
            docs.select(
                F.col(id_col).alias("doc_id"),
                F.col(source_col).cast("string").alias("source"),
                F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                F.xxhash64(text).alias("text_key"),
            ),
            "mix-sizes",
        )
        length, size = F.lit(block_words), F.col("source_size")
        wanted = F.when(size > 0, F.round("target").cast("long")).otherwise(F.lit(0).cast("long"))
        full = F.when(size > 0, F.floor(F.col("wanted") / size)).otherwise(F.lit(0)).cast("long")
        short = size - (F.col("n_blocks") - 1) * length
        # Slots that cover what whole turns leave, even if the short last block is among them.
        partial = F.when(F.col("rest") > 0, F.least("n_blocks", F.ceil((F.col("rest") + length - F.col("short")) / length)))
        last_at = permuted(F.col("n_blocks") - 1, F.col("n_blocks"), self.seed, F.col("rank"), F.col("full"), inverse=True)
        counted = (
            source_targets(self.sizes, weights, share, most)
            .withColumn("n_blocks", F.ceil(size / length).cast("long"))
            .withColumn("wanted", wanted)
            .withColumn("full", full)
            .withColumn("rest", F.col("wanted") - F.col("full") * size)
            .withColumn("short", short)
            .withColumn("short_at", F.when(size > 0, last_at))
            .withColumn("n_slots", (F.col("full") * F.col("n_blocks") + F.coalesce(partial, F.lit(0))).cast("long"))
        )
        first = F.sum("n_slots").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
        self.sources = written_table(counted.withColumn("first_slot", F.coalesce(first, F.lit(0))), "mix-sources")
        self.n_slots, self._rows = (
            self.sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0],
            self.sizes.count(),
        )
        self.counts = written_table(self._draw(), "mix-counts")

    def _draw(self) -> DataFrame:
        """How many slots of each shard go to each source: shard, rank, n.

        All slots of the mix are dealt to its places by one keyed permutation, and counted per shard. That
        draws the counts as a multinomial would, given that the sources' totals are their targets.
        """
        given = self.sources.where("n_slots > 0").select("rank", "n_slots", "first_slot")
        starts = F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1, F.lit(SLOTS_PER_ROW).cast("long"))
        # Stretches of slots are dealt out first. A stated number of partitions: by bytes they would be one.
        dealt = given.withColumn("from", F.explode(starts)).repartition(
            int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rank", "from"
        )
        last = F.least(F.col("from") + SLOTS_PER_ROW, F.col("n_slots")) - 1
        each = dealt.withColumn("slot", F.explode(F.sequence(F.col("from"), last)))
        place = permuted(F.col("first_slot") + F.col("slot"), F.lit(max(1, self.n_slots)).cast("long"), self.seed)
        shard = F.floor(place / self.shard_blocks).cast("long").alias("shard")
        return each.groupBy(shard, "rank").agg(F.count("*").alias("n"))

    def slots(self) -> DataFrame:
        """The mix: shard, position (in the mix), rank (of the source), turn (0 the first use), block, and how
        many of the block's words are used.

        A source's slots are numbered through its shards; a turn of its slots goes through all its blocks in
        the order of a permutation. The slots of the last, partial turn give the words still missing.
        """
        before = Window.rowsBetween(Window.unboundedPreceding, -1)
        of_source = F.sum("n").over(before.partitionBy("rank").orderBy("shard"))
        of_shard = F.sum("n").over(before.partitionBy("shard").orderBy("rank"))
        whole = F.sum("n").over(Window.partitionBy("shard"))
        drawn = self.counts.select(
            "shard",
            "rank",
            "n",
            F.coalesce(of_source, F.lit(0)).alias("first"),
            F.coalesce(of_shard, F.lit(0)).alias("from"),
            whole.alias("in_shard"),
        )
        given = checked_lookup(
            self.sources.where("n_slots > 0").select("rank", "n_blocks", "source_size", "full", "rest", "short", "short_at")
        )
        # A stated number of partitions: the counts are few, the slots many.
        dealt = drawn.join(given, "rank").repartition(
            int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "rank"
        )
        each = dealt.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        slot, length = F.col("first") + F.col("i"), F.lit(self.block_words)
        turn, at = F.floor(slot / F.col("n_blocks")), F.pmod(slot, F.col("n_blocks"))
        block = permuted(F.col("at"), F.col("n_blocks"), self.seed, F.col("rank"), F.col("turn"))
        holds = F.when(F.col("block") == F.col("n_blocks") - 1, F.col("short")).otherwise(length)
        earlier = F.col("at") * length - F.when(F.col("short_at") < F.col("at"), length - F.col("short")).otherwise(0)
        missing = F.greatest(F.col("rest") - earlier, F.lit(0))
        use = F.when(F.col("turn") < F.col("full"), holds).otherwise(F.least(holds, missing))
        inside = permuted(F.col("from") + F.col("i"), F.col("in_shard"), self.seed, F.col("shard"), F.lit("place"))
        return (
            each.withColumn("turn", turn)
            .withColumn("at", at)
            .withColumn("block", block)
            .select(
                "shard",
                (F.col("shard") * self.shard_blocks + inside).alias("position"),
                "rank",
                "turn",
                "block",
                use.cast("long").alias("use"),
            )
        )

    def placed(self) -> DataFrame:
        """Documents with their source's figures and where they start in its stream."""
        cells = max(256, self._rows // CELL_ROWS)
        known = checked_lookup(self.sources.select("source", "rank", "source_size", "target"))
        ranked = join_lookup(self.sizes, known, ["source"], "inner").withColumn(
            "cell", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(cells).cast("long"))
        )
        sums = ranked.groupBy("rank", "cell").agg(F.sum("size").alias("words"))
        earlier = Window.partitionBy("rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select(
            F.col("rank").alias("of_rank"),
            F.col("cell").alias("of_cell"),
            F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"),
        )
        inside = (
            Window.partitionBy("rank", "cell")
            .orderBy("doc_id", "text_key", "size")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return (
            ranked.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(offsets, (F.col("rank") == F.col("of_rank")) & (F.col("cell") == F.col("of_cell")))
            .withColumn("start", F.col("offset") + F.col("inside"))
            .drop("of_rank", "of_cell", "offset", "inside", "cell")
        )

    def spans(self, placed: DataFrame) -> DataFrame:
        """Which words of which document a block holds: rank, block, start (the document's), low, high."""
        length = self.block_words
        numbers = F.sequence(
            F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("size") - 1) / length)
        )
        return (
            placed.where("size > 0")
            .select("rank", "start", "size", F.explode(numbers).alias("block"))
            .select(
                "rank",
                "block",
                "start",
                (F.greatest(F.col("block") * length, "start") - F.col("start")).alias("low"),
                (F.least((F.col("block") + 1) * length, F.col("start") + F.col("size")) - F.col("start")).alias("high"),
            )
        )

    def _used(self, placed: DataFrame) -> DataFrame:
        """Spans of documents that slots use, cut where a slot uses less than its block."""
        # The slots come from a small table, so without a hint their number would be underestimated.
        slots = self.slots().where("use > 0").select("shard", "rank", "turn", "block", "use")
        used = self.spans(placed).join(slots.hint("merge"), ["rank", "block"])
        end = F.col("block") * self.block_words + F.col("use") - F.col("start")
        return used.withColumn("high", F.least(F.col("high"), end)).where("high > low")

    def taken(self) -> DataFrame:
        """Per document: doc_id, size, source, source_size, target, taken (its words in the mix) and the shards
        that use it, ascending."""
        placed = self.placed()
        used = self._used(placed)
        words = used.groupBy(F.col("rank").alias("of_rank"), F.col("start").alias("of_start")).agg(
            F.sum(F.col("high") - F.col("low")).alias("words"), F.sort_array(F.collect_set("shard")).alias("in_shards")
        )
        mine = (F.col("rank") == F.col("of_rank")) & (F.col("start") == F.col("of_start")) & (F.col("size") > 0)
        return placed.join(words, mine, "left").select(
            "doc_id",
            "size",
            "source",
            "source_size",
            "target",
            F.coalesce("words", F.lit(0)).alias("taken"),
            F.coalesce("in_shards", F.array().cast("array<bigint>")).alias("shards"),
        )

    def documents(self) -> DataFrame:
        """The mix as documents: all columns of the input, one row per document and use, with the words used.

        A document used whole keeps its text; of one used in part, the words used are joined by one
        space. Rows come from the input by id and text.
        """
        placed = self.placed()
        used = self._used(placed)
        parts = used.groupBy("rank", "start", "turn").agg(
            F.sum(F.col("high") - F.col("low")).alias("words"),
            F.sort_array(F.collect_list(F.struct("low", "high"))).alias("parts"),
        )
        owner = placed.select(
            F.col("rank").alias("of_rank"), F.col("start").alias("of_start"), "doc_id", "text_key", "size"
        ).where("size > 0")
        uses = parts.join(owner, (F.col("rank") == F.col("of_rank")) & (F.col("start") == F.col("of_start"))).select(
            F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "words", "parts", "size"
        )
        text = F.col(self.text_col)
        source = self.docs.withColumn("__own", F.xxhash64(text.cast("string"))).dropDuplicates([self.id_col, "__own"])
        names = [c for c in self.docs.columns]
        uses = uses.select("__id", "__key", F.struct("words", "parts", "size").alias("__use"))
        every = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
        chosen = F.flatten(
            F.transform("__use.parts", lambda p: F.slice(F.col("__words"), (p["low"] + 1).cast("int"), (p["high"] - p["low"]).cast("int")))
        )
        return (
            source.join(uses, source[self.id_col].eqNullSafe(uses["__id"]) & (F.col("__own") == F.col("__key")))
            .withColumn("__words", F.when(F.col("__use.words") < F.col("__use.size"), every))
            .withColumn(
                self.text_col, F.when(F.col("__words").isNull(), text).otherwise(F.array_join(chosen, " "))
            )
            .select(*names)
        )

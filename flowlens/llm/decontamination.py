"""Benchmark decontamination by a distributed positional index, with DataFrame functions only.

The training texts' occurrences of each test term are counted first, combined before the shuffle.
Then every occurrence of a term that is one of the two rarest of some test phrase becomes a posting
(document, position, term). For each phrase the postings of its two rarest terms, moved back by the
terms' offsets in the phrase, are intersected; what remains is compared with the words of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.shared import LOOKUP_ROWS, checked_lookup, collect_lookup, written_table

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(1 << 63)
# Terms that a broadcast may hold.
TERM_ROWS = LOOKUP_ROWS


def words_of(text: Column) -> Column:
    """Words of a text as they are written: runs of ASCII letters and digits and of all other characters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(word: Column) -> Column:
    """A-Z in lower case, everything else as it is. Most words have no capital, which ``lower`` tells fast."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def phrases_of(items: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """Test phrases: item_id, phrase_id, phrase. Runs of ``size`` words; all words of a shorter item."""
    words = F.transform(words_of(F.col(text_col).cast("string")), ascii_lower)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return (
        items.select(F.col(item_col).alias("item_id"), words.alias("words"))
        .where("size(words) > 0")
        .select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("phrase"))
        .withColumn("phrase_id", F.xxhash64("phrase"))
        .distinct()
    )


class PositionalIndex:
    """Postings of the training texts for the two rarest terms of each phrase of a test set."""

    def __init__(
        self,
        docs: DataFrame,
        items: DataFrame,
        size: int = 10,
        id_col: str = "doc_id",
        text_col: str = "text",
        item_col: str = "item_id",
        item_text_col: str = "text",
    ):
        """
        Words are runs of characters other than ASCII non-alphanumerics; A-Z count as a-z. Null texts
        have no words. Rows are told apart by id and text, so repeated rows get equal results, and
        rows without id are treated like others. Other columns are ignored. Empty tables are allowed.
        """
        text = F.col(text_col).cast("string")
        self.docs = docs.select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
            F.xxhash64(text).alias("text_key"),
            text.alias("text"),
        )
        self.items = written_table(phrases_of(items, size, item_col, item_text_col), "test-phrases")
        self.phrases = self.items.select("phrase_id", "phrase").distinct()
        terms = self.phrases.select("phrase_id", F.size("phrase").alias("n"), F.posexplode("phrase").alias("offset", "term"))
        spelled = self.docs.select("doc", "text_key", F.posexplode(words_of(F.col("text"))).alias("position", "word"))
        found = spelled.withColumn("term", ascii_lower(F.col("word")))
        vocabulary = terms.select(F.col("term").alias("known")).distinct()
        lookup = collect_lookup(vocabulary, TERM_ROWS)
        everything = None
        if lookup is not None:
            vocabulary = F.broadcast(items.sparkSession.createDataFrame(lookup, vocabulary.schema))
            counted = found.join(vocabulary, F.col("term") == F.col("known")).groupBy("term")
            counts = counted.agg(F.count("*").alias("postings"))
        else:
            # Too many terms to broadcast: all words are counted, which combines before the shuffle.
            everything = written_table(found.groupBy("term").agg(F.count("*").alias("postings")), "word-counts")
            counts = everything.join(vocabulary, F.col("term") == F.col("known"), "left_semi")
        counts = counts.withColumnRenamed("term", "counted")
        rarest = Window.partitionBy("phrase_id").orderBy("postings", "offset")
        whole = F.count("postings").over(Window.partitionBy("phrase_id")) == F.col("n")
        # A phrase with a term that no text has cannot occur.
        self.anchors = written_table(
            terms.join(counts, F.col("term") == F.col("counted"))
            .withColumn("whole", whole)
            .withColumn("rank", F.row_number().over(rarest))
            .where("whole and rank <= 2")
            .select("phrase_id", "n", "offset", F.col("term").alias("anchor"), "rank"),
            "anchors",
        )
        self.postings = written_table(self._posted(found, everything), "postings")

    def _posted(self, found: DataFrame, everything: DataFrame | None) -> DataFrame:
        """Occurrences of anchor terms: doc, text_key, position, term."""
        place = ["doc", "text_key", "position", "term"]
        anchors = self.anchors.select(F.col("anchor").alias("known")).distinct()
        same = F.col("term") == F.col("known")
        lookup = collect_lookup(anchors, TERM_ROWS)
        if lookup is not None:
            few = F.broadcast(found.sparkSession.createDataFrame(lookup, anchors.schema))
            return found.join(few, same, "left_semi").select(place)
        # The most frequent words never shuffle: a broadcast tells which of them are anchors.
        frequent = everything.orderBy(F.desc("postings"), "term").limit(TERM_ROWS).select("term")
        told = frequent.join(anchors.withColumn("wanted", F.lit(True)), same, "left").select(
            F.col("term").alias("frequent"), F.coalesce("wanted", F.lit(False)).alias("wanted")
        )
        told = found.join(F.broadcast(written_table(told, "frequent-words")), F.col("term") == F.col("frequent"), "left")
        hot = told.where("wanted").select(place)
        return hot.unionByName(told.where("wanted is null").join(anchors, same, "left_semi").select(place))

    def _candidates(self, slop: int) -> DataFrame:
        """Documents and starts at which the two rarest terms agree: doc, text_key, phrase_id, start."""
        place = ["doc", "text_key", "phrase_id"]
        anchors = checked_lookup(self.anchors)
        moved = self.postings.join(anchors, F.col("term") == F.col("anchor")).select(
            *place, "n", "rank", (F.col("position") - F.col("offset")).alias("start")
        )
        if not slop:
            met = moved.where("start >= 0").groupBy(*place, "start").agg(
                F.min("rank").alias("first"), F.max("rank").alias("last"), F.first("n").alias("n")
            )
            return met.where((F.col("first") == 1) & (F.col("last") == F.least("n", F.lit(2)))).select(*place, "start")
        cell = F.floor(F.col("start") / (slop + 1))
        lone = moved.where("n = 1").select(*place, "start")
        one = moved.where("rank = 1 and n > 1").select(*place, "start", cell.alias("cell"))
        two = moved.where("rank = 2").select(
            *place, F.col("start").alias("other"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")
        )
        near = one.join(two, [*place, "cell"]).where(F.abs(F.col("start") - F.col("other")) <= slop)
        return near.select(*place, "start").distinct().unionByName(lone)

    def matches(self, slop: int = 0) -> DataFrame:
        """Per text with matches: doc, text_key and found, an array of (phrase_id, start, n).

        Without slop these are the exact phrases. With slop, a phrase is found where its two rarest
        terms lie within ``slop`` words of their places and all its words occur in the stretch of n
        words from start, widened by slop on either side; start is where the rarest term puts it.
        """
        phrases = checked_lookup(self.phrases.select(F.col("phrase_id").alias("of"), "phrase"))
        start = F.struct("phrase_id", "start", F.size("phrase").alias("n"), "phrase")
        wanted = (
            self._candidates(slop)
            .join(phrases, F.col("phrase_id") == F.col("of"))
            .groupBy("doc", "text_key")
            .agg(F.collect_list(start).alias("wanted"))
        )
        texts = self.docs.join(wanted.withColumnsRenamed({"doc": "in_doc", "text_key": "in_key"}), (F.col("doc") == F.col("in_doc")) & (F.col("text_key") == F.col("in_key")))

        def there(c: Column) -> Column:
            low = F.greatest(c["start"] - slop, F.lit(0))
            stretch = F.transform(F.slice(F.col("words"), low + 1, c["start"] + c["n"] + slop - low), ascii_lower)
            return stretch == c["phrase"] if not slop else F.size(F.array_except(c["phrase"], stretch)) == 0

        kept = F.filter("wanted", there)
        return (
            texts.dropDuplicates(["doc", "text_key"])
            .withColumn("words", words_of(F.col("text")))
            .select("doc", "text_key", F.transform(kept, lambda c: F.struct(c["phrase_id"], c["start"], c["n"])).alias("found"))
            .where("size(found) > 0")
        )

    def report(self, slop: int = 0) -> DataFrame:
        """Per row of the texts: doc_id, text_key, n_words, n_hit, n_items, items_sha256 and contaminated.

        n_hit counts the words inside a match, n_items the items whose phrases occur. Lists of items
        are sorted as strings and joined by commas.
        """
        matched = written_table(self.matches(slop), "matches")
        covered = F.array_distinct(
            F.flatten(F.transform("found", lambda m: F.sequence(m["start"], m["start"] + m["n"] - 1)))
        )
        owners = checked_lookup(self.items.select(F.col("phrase_id").alias("of"), F.col("item_id").cast("string").alias("item")))
        items = (
            matched.select("doc", "text_key", F.explode(F.array_distinct("found.phrase_id")).alias("phrase_id"))
            .join(owners, F.col("phrase_id") == F.col("of"))
            .groupBy("doc", "text_key")
            .agg(F.sort_array(F.collect_set("item")).alias("items"))
        )
        hits = (
            matched.select("doc", "text_key", F.size(covered).cast("long").alias("n_hit"))
            .join(items, ["doc", "text_key"])
            .withColumnsRenamed({"doc": "in_doc", "text_key": "in_key"})
        )
        texts = self.docs.select(
            "doc", "text_key", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")
        )
        n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
        return texts.join(
            hits, (F.col("doc") == F.col("in_doc")) & (F.col("text_key") == F.col("in_key")), "left"
        ).select(
            F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"),
            "text_key",
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
        )

"""What the miner reads: staged facts, the items worth keeping, and baskets.

Facts are kept one per row. They combine before every shuffle, and no entity's
facts are gathered in one place until the items below their window's cut, which
are in no frequent itemset, are gone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import Staged, stage, weighted_join
from .transactions import fact_items, transactions_per_window
from .windows import WindowPlan, join_plan

_BITS = 64
_WORD_SHIFT = 6
# Up to this many windows a fact's windows are bits of a few longs.
MASK_WINDOWS = 8 * _BITS
# Up to this many longs hold what a subject has of all frequent items.
PACKED_WORDS = 32
_WINDOW_BITS = 9
_SPANS = "snapshot string, n_triples long, first_window int, last_window int"


@dataclass(frozen=True)
class DictionarySize:
    """Frequent (window, item) pairs, their bytes and how often they occur."""

    items: int
    bytes: int
    occurrences: int


@dataclass(frozen=True)
class LongItems:
    """One row per window, entity and item, without duplicates."""

    staged: Staged
    rows: DataFrame
    entity: str
    sizes: DataFrame

    def counted(self) -> DataFrame:
        """How often each window has an item: ``window_id, item, freq``."""
        return self.rows.groupBy("window_id", "item").agg(F.count("*").alias("freq"))

    def dictionary(self, frequent: DataFrame) -> DataFrame:
        """Number every frequent (window, item).

        Numbers follow the partition a row is in, so no order over all items is
        needed; they are fixed once the dictionary is written.
        """
        return frequent.withColumn("item_id", F.monotonically_increasing_id())

    def singles(self, dictionary: DataFrame) -> DataFrame:
        return dictionary

    def baskets(self, dictionary: DataFrame, size: DictionarySize) -> DataFrame:
        """Numbers of the frequent items of each transaction that has several."""
        numbers = dictionary.select("window_id", "item", "item_id", F.col("freq").alias("weight"))
        on = ["window_id", "item"]
        return (
            weighted_join(self.rows, numbers, on, size.bytes, size.occurrences)
            .groupBy("window_id", self.entity)
            .agg(F.collect_list("item_id").alias("ids"))
            .where(F.size("ids") > 1)
            .select("window_id", "ids")
        )


@dataclass(frozen=True)
class MaskedItems:
    """One row per entity and item, its windows being bits of ``words``."""

    staged: Staged
    words: list[str]
    n_windows: int

    @property
    def rows(self) -> DataFrame:
        return self.staged.frame.select(F.explode(self.window_ids()).alias("window_id"), "item")

    def counted(self) -> DataFrame:
        """How often each window has an item: ``window_id, item, freq``."""
        return self._per_window(self.staged.frame, ["item"], "freq")

    @property
    def sizes(self) -> DataFrame:
        entities = self.staged.frame.groupBy("subject").agg(*_merged(self.words))
        return self._per_window(entities, [], "n_transactions")

    def _per_window(self, masked: DataFrame, keys: list[str], name: str) -> DataFrame:
        """Rows of each window and key. Rows with the same windows are counted before they come apart."""
        alike = masked.groupBy(*keys, *self.words).agg(F.count("*").alias("_n"))
        apart = alike.select(F.explode(self.window_ids()).alias("window_id"), *keys, "_n")
        return apart.groupBy("window_id", *keys).agg(F.sum("_n").alias(name))

    def window_ids(self) -> Column:
        """The windows whose bit is set, in order."""
        return F.concat(
            *(
                F.filter(ids, lambda k: F.getbit(word, k - first) == 1)
                for word, first, ids in self._word_ranges()
            )
        )

    def _word_ranges(self) -> list[tuple[str, int, Column]]:
        """Each word with its first window and the windows it stands for."""
        return [
            (word, first, F.sequence(F.lit(first), F.lit(min(first + _BITS, self.n_windows) - 1)))
            for word, first in zip(self.words, range(0, MASK_WINDOWS, _BITS))
        ]

    def dictionary(self, frequent: DataFrame) -> DataFrame:
        """Number every frequent item and mark the windows it is frequent in.

        The lowest bits of a number are left free for the window, which leaves room
        for two million partitions.
        """
        marks = [
            F.bit_or(
                F.when(
                    F.shiftright("window_id", _WORD_SHIFT) == i,
                    _bit(F.col("window_id") - i * _BITS),
                ).otherwise(F.lit(0).cast("long"))
            ).alias(f"f{i}")
            for i in range(len(self.words))
        ]
        per_window = F.struct("window_id", "freq", "n_tx", "cut")
        number = F.shiftleft(F.monotonically_increasing_id(), _WINDOW_BITS)
        return (
            frequent.groupBy("item")
            .agg(
                F.collect_list(per_window).alias("windows"), F.sum("freq").alias("weight"), *marks
            )
            .withColumn("item_id", number)
        )

    def singles(self, dictionary: DataFrame) -> DataFrame:
        return dictionary.select("item", "item_id", F.inline("windows")).withColumn(
            "item_id", F.col("item_id") + F.col("window_id")
        )

    def baskets(self, dictionary: DataFrame, size: DictionarySize) -> DataFrame:
        """Numbers of the frequent items of each transaction that has several.

        A fact is shuffled once, not once per window; the windows come apart
        after an entity's frequent items, at most all there are, have met.
        """
        frequent = [f"f{i}" for i in range(len(self.words))]
        shared = [
            F.col(word).bitwiseAND(F.col(mark)).alias(word)
            for word, mark in zip(self.words, frequent)
        ]
        kept = weighted_join(
            self.staged.frame,
            dictionary.select("item", "item_id", "weight", *frequent),
            ["item"],
            size.bytes,
            size.occurrences,
        ).select("subject", "item_id", *shared)
        any_window = F.lit(False)
        for word in self.words:
            any_window = any_window | (F.col(word) != 0)
        kept = kept.where(any_window)
        most = PACKED_WORDS // len(self.words)
        numbers = [r["item_id"] for r in dictionary.select("item_id").limit(most + 1).collect()]
        if 0 < len(numbers) <= most:
            return self._packed_baskets(kept, numbers)
        entities = (
            kept.groupBy("subject")
            .agg(F.collect_list(F.struct("item_id", *self.words)).alias("facts"))
            .where(F.size("facts") > 1)
        )

        def in_window(k: Column, word: str, first: int) -> Column:
            held = F.filter("facts", lambda fact: F.getbit(fact[word], k - first) == 1)
            return F.struct(
                k.alias("window_id"), F.transform(held, lambda fact: fact["item_id"] + k).alias("ids")
            )

        baskets = F.concat(
            *(
                F.transform(ids, lambda k: in_window(k, word, first))
                for word, first, ids in self._word_ranges()
            )
        )
        return entities.select(F.inline(baskets)).where(F.size("ids") > 1)

    def _packed_baskets(self, kept: DataFrame, numbers: list[int]) -> DataFrame:
        """``baskets`` when few items are frequent: merged in columns for each, not in a list."""
        columns = [[f"i{i}_{word}" for word in self.words] for i in range(len(numbers))]
        merged = [
            F.bit_or(F.when(F.col("item_id") == number, F.col(word)).otherwise(F.lit(0).cast("long"))).alias(name)
            for number, names in zip(numbers, columns)
            for name, word in zip(names, self.words)
        ]
        window_id = F.col("window_id")

        def held(names: list[str]) -> Column:
            word = F.array(*names)[F.shiftright(window_id, _WORD_SHIFT)] if len(names) > 1 else F.col(names[0])
            return F.getbit(word, window_id.bitwiseAND(F.lit(_BITS - 1)))

        none = F.array().cast("array<bigint>")
        ids = F.concat(
            *(
                F.when(held(names) == 1, F.array(F.lit(number).cast("long") + window_id)).otherwise(none)
                for number, names in zip(numbers, columns)
            )
        )
        windows = F.explode(F.sequence(F.lit(0), F.lit(self.n_windows - 1))).alias("window_id")
        return (
            kept.groupBy("subject")
            .agg(*merged)
            .select("*", windows)
            .where(sum((held(names).cast("int") for names in columns), F.lit(0)) > 1)
            .select("window_id", ids.alias("ids"))
        )


def _merged(words: list[str]) -> list[Column]:
    return [F.bit_or(word).alias(word) for word in words]


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position)


def items_of_windowed(windowed: DataFrame, include_literals: bool = False) -> LongItems:
    """Mining input from window-tagged triples."""
    distinct = fact_items(windowed, include_literals).select("window_id", "subject", "item").distinct()
    return _long_items(distinct)


def _long_items(distinct: DataFrame) -> LongItems:
    staged = stage(distinct, "window-items")
    sizes = transactions_per_window(staged.frame.select("window_id", "subject").distinct())
    return LongItems(staged, staged.frame, "subject", sizes)


def items_of_transactions(transactions: DataFrame) -> LongItems:
    """Mining input from ready transactions, each row being one of them."""
    numbered = transactions.select(
        "window_id",
        F.monotonically_increasing_id().alias("transaction"),
        F.array_distinct("items").alias("items"),
    )
    # Written before use, so a number stays with its row.
    staged = stage(numbered, "transactions")
    rows = staged.frame.select("window_id", "transaction", F.explode("items").alias("item"))
    return LongItems(staged, rows, "transaction", transactions_per_window(staged.frame))


def items_of_triples(
    triples: DataFrame, plan: WindowPlan, include_literals: bool = False
) -> LongItems | MaskedItems:
    """Mining input straight from temporal triples.

    Tagging triples with windows first repeats each of them once per window
    before the shuffle. Here a snapshot's windows are bits, and one shuffle
    merges a fact's bits over all snapshots, however many windows overlap.
    """
    items = fact_items(triples, include_literals).select("snapshot", "subject", "item")
    if plan.rows is None or plan.n_windows > MASK_WINDOWS:
        spans = ["first_window", "last_window"]
        tagged = join_plan(items, plan, plan.spans, spans)
        window_id = F.explode(F.sequence(*spans)).alias("window_id")
        return _long_items(tagged.select(window_id, "subject", "item").distinct())

    words = [f"w{i}" for i in range(max(1, -(-plan.n_windows // _BITS)))]
    masks = triples.sparkSession.createDataFrame(
        [
            (
                *(row[name] for name in ("snapshot", "n_triples", "first_window", "last_window")),
                *_mask(row["first_window"], row["last_window"], len(words)),
            )
            for row in plan.rows
        ],
        ", ".join([_SPANS, *(f"{word} long" for word in words)]),
    )
    facts = join_plan(items, plan, masks, words).groupBy("subject", "item").agg(*_merged(words))
    return MaskedItems(stage(facts, "fact-windows"), words, plan.n_windows)


def _mask(first: int, last: int, n_words: int) -> list[int]:
    """Bits ``first`` to ``last`` as signed 64-bit words, lowest bits first; none if they are reversed."""
    bits = (1 << (last + 1)) - (1 << first) if first <= last else 0
    words = [(bits >> (_BITS * i)) & ((1 << _BITS) - 1) for i in range(n_words)]
    return [word - (1 << _BITS) if word >> (_BITS - 1) else word for word in words]

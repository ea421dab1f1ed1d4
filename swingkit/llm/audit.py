"""How filters interact: what each would remove in every order, from decision diagrams of failure masks.

Spark reduces the documents to counts by part and failure mask (bit k is set if filter k fails), at most 2**filters rows
a part. A part's counts make a decision diagram with a level for each filter: an edge to what passes and one to what
fails, equal sub-diagrams shared, empty ones a single node, and every node weighted with the counts below it. The orders
are walked by adjacent swaps (Steinhaus, Johnson and Trotter), each of which rebuilds the nodes of two levels only. In
every order the path on which all pass yields the steps: a step keeps the weight of the next node on the path and removes
the weight of the failing edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swingkit.llm.common import kept, table, words

#: Weights of a mask: documents, good ones and toxic ones.
WEIGHTS = ("n", "good", "toxic")
#: Orders grow with the factorial of the filters.
MOST_FILTERS = 8
FILTERS = "ABCDE"

Weight = tuple[int, ...]


class Diagram:
    """A count-weighted decision diagram of failure masks over the filters ``0 .. n - 1``, whose levels can be swapped.

    Node 0 is empty. A node is (filter, node of what passes, node of what fails); the last level points at leaves.
    """

    def __init__(self, n: int, counts: dict[int, Weight], width: int = len(WEIGHTS)) -> None:
        self.order = list(range(n))
        self.nothing = (0,) * width
        self.weight: list[Weight] = [self.nothing]
        self.below: list[tuple[int, int, int]] = [(-1, 0, 0)]
        self._known: dict[tuple, int] = {}
        self.root = self._build(0, counts)

    def _node(self, key: tuple, weight: Weight) -> int:
        if weight == self.nothing:
            return 0
        if key not in self._known:
            self._known[key] = len(self.below)
            self.below.append(key if len(key) == 3 else (-1, 0, 0))
            self.weight.append(weight)
        return self._known[key]

    def _join(self, which: int, passes: int, fails: int) -> int:
        return self._node((which, passes, fails), tuple(a + b for a, b in zip(self.weight[passes], self.weight[fails], strict=True)))

    def _build(self, level: int, counts: dict[int, Weight]) -> int:
        if not counts:
            return 0
        if level == len(self.order):
            (weight,) = counts.values()
            return self._node(("leaf", weight), weight)
        bit = 1 << self.order[level]
        passes, fails = ({m: w for m, w in counts.items() if bool(m & bit) == failed} for failed in (False, True))
        return self._join(self.order[level], self._build(level + 1, passes), self._build(level + 1, fails))

    def swap(self, level: int) -> None:
        """Swaps ``level`` with the next; the nodes below stay as they are."""
        upper, lower = self.order[level : level + 2]
        done: dict[int, int] = {}

        def turned(node: int, at: int) -> int:
            if not node:
                return 0
            if node not in done:
                which, passes, fails = self.below[node]
                if at < level:
                    done[node] = self._join(which, turned(passes, at + 1), turned(fails, at + 1))
                else:
                    (_, pp, pf), (_, fp, ff) = self.below[passes], self.below[fails]
                    done[node] = self._join(lower, self._join(upper, pp, fp), self._join(upper, pf, ff))
            return done[node]

        self.root = turned(self.root, 0)
        self.order[level], self.order[level + 1] = lower, upper

    def steps(self) -> Iterator[tuple[int, Weight, Weight]]:
        """Filter, weight kept and weight removed of each step, along the path on which all pass."""
        node = self.root
        for which in self.order:
            _, passes, fails = self.below[node]
            yield which, self.weight[passes], self.weight[fails]
            node = passes


def adjacent_swaps(n: int) -> Iterator[int]:
    """The levels to swap with their next so that all orders of ``n`` are met once each: the greatest goes through the rest and back."""
    if n < 2:
        return
    down = True
    for rest in [*adjacent_swaps(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if rest is not None:
            yield rest + down
        down = not down


def audit_rows(counts: dict[int, Weight], names: str) -> list[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley of every order and step."""
    diagram = Diagram(len(names), counts)
    fails = [sum(w[0] for m, w in counts.items() if m >> k & 1) for k in range(len(names))]
    alone = [counts.get(1 << k, diagram.nothing)[0] for k in range(len(names))]
    shapley, out = [0] * len(names), []
    for level in [None, *adjacent_swaps(len(names))]:
        if level is not None:
            diagram.swap(level)
        order = "".join(names[k] for k in diagram.order)
        for step, (k, stays, goes) in enumerate(diagram.steps(), 1):
            shapley[k] += goes[0]
            out.append((order, step, stays[0], goes[0], fails[k] - goes[0], alone[k], goes[1], goes[2]))
    return [(*row, shapley[names.index(row[0][row[1] - 1])]) for row in out]


def audit(counts: DataFrame, names: str) -> DataFrame:
    """The rows of :func:`audit_rows` for every ``part`` of ``counts`` (part, mask, n, good, toxic; a row for each mask)."""
    if not 1 <= len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"name 1 to {MOST_FILTERS} filters with a different letter each")

    def of_part(key: tuple[str], own: pd.DataFrame) -> pd.DataFrame:
        weights = {int(m): tuple(map(int, w)) for m, *w in own[["mask", *WEIGHTS]].itertuples(index=False)}
        out = pd.DataFrame(audit_rows(weights, names), columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
        return out.assign(part=key[0])

    longs = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return counts.groupBy("part").applyInPandas(of_part, f"part string, filter_order string, step int, {longs}")


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (under 200 words), B (under half of them distinct), C (over 3 % capitals), D (holds a mark)."""
    w = words(text)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [F.size(w) < 200, 100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]


def mask_of(failures: Iterable[Column]) -> Column:
    return F.aggregate(F.array(*(f.cast("int") for f in failures)), F.struct(F.lit(0).alias("mask"), F.lit(1).alias("bit")), lambda a, f: F.struct((a["mask"] + f * a["bit"]).alias("mask"), (a["bit"] * 2).alias("bit")), lambda a: a["mask"])


def failure_masks(docs: DataFrame, failures: Callable[[Column], Sequence[Column]], key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``key``, ``part``, ``mask`` and ``digest`` (SHA-256 of the text) of every document; a null text or part counts as empty."""
    body = F.coalesce(text, F.lit(""))
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask_of(failures(body)).alias("mask"), F.unhex(F.sha2(body, 256)).alias("digest"))


def with_copies(masks: DataFrame, bit: int) -> DataFrame:
    """``masks`` with ``bit`` set on every row whose text has a smaller key somewhere in the table; a null key is neither smaller nor larger.

    Only the least key of a digest, found with partial aggregation, meets the rows again, on digest and key together: a
    text with a third of all rows is spread by its keys.
    """
    firsts = masks.filter("key is not null").groupBy("digest").agg(F.min("key").alias("key")).withColumn("_first", F.lit(True))
    copy = F.col("key").isNotNull() & F.col("_first").isNull()
    return masks.join(firsts, ["digest", "key"], "left").withColumn("mask", F.col("mask") + F.when(copy, bit).otherwise(0)).drop("_first")


def mask_counts(masks: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """part, mask, n, good and toxic: documents, and those that a label of their key calls good or toxic. Repeated labels count once."""
    is_ = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(is_("quality"), is_("toxic"))
    joined = masks.join(known, "key", "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def op11_diagram_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all ``documents``, audited in their 120 orders for every language. An empty table has no part and no rows.

    Rows that repeat a doc_id are documents of their own; of equal texts those of the least doc_id pass E, all of them.
    """
    docs = table(spark, sf_dir, "documents")
    masks = kept(failure_masks(docs, text_failures), "masks")[0]
    return audit(mask_counts(with_copies(masks, 1 << FILTERS.index("E")), table(spark, sf_dir, "labels")), FILTERS)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(lang AS VARCHAR), '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d
), l AS (
  SELECT doc_id, coalesce(max(CAST(quality = 1 AS INTEGER)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INTEGER)), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), m AS (
  SELECT part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN coalesce(w.doc_id > first, false) THEN 16 ELSE 0 END AS mask,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id GROUP BY ALL
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS prior FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE mask & CAST(bit + prior AS INTEGER) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & CAST(prior AS INTEGER) = 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & CAST(prior AS INTEGER) <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & CAST(prior AS INTEGER) = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & CAST(prior AS INTEGER) = 0), 0) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""

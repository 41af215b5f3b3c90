"""Hard negatives by branch and bound over ball trees, one tree per slice of the rows.

A ball of centre c and radius r bounds the inner product of an anchor q with
its rows from both sides: q.c - |q| r and q.c + |q| r. A tree is searched for
many anchors at once; each node keeps the anchors whose score window its ball
meets and whose present kth score its upper bound reaches. A node whose upper
bound equals the kth score is entered, as ties go to the smaller id. Leaves
are scored by one matrix product. Slices and blocks of anchors meet in groups
of bounded size, and only the best few of each group are shuffled again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.llm.store import Store
from inkframe.llm.vectors import common_width, finite, largest, matrix, scaled


@dataclass(frozen=True)
class Settings:
    """``positives`` of each anchor and ``negatives`` of each positive, of a
    score between ``low`` and ``high`` percent of the positive's. Components
    become floor(scale * x). A tree holds about ``tree`` rows with leaves of
    ``leaf``; about ``anchors`` anchors meet a tree in one task."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    tree: int = 8192
    leaf: int = 64
    anchors: int = 1024


@dataclass(frozen=True)
class Tree:
    """Rows in the order of the tree; node i has rows low[i] to high[i], and the children child[i] and child[i] + 1, or 0 at a leaf."""

    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray

    def is_leaf(self, node: int) -> bool:
        return self.child[node] == 0


def build(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int) -> Tree:
    """Cuts rows along the line from the row farthest from the centre to the row
    farthest from that one, at the widest gap of the middle half, down to ``leaf`` rows."""
    order = np.arange(len(x))
    low, high, child, centre, radius = [0], [len(x)], [0], [], []
    node = 0
    while node < len(low):
        a, b = low[node], high[node]
        held = x[order[a:b]]
        centre.append(held.mean(axis=0))
        away = ((held - centre[node]) ** 2).sum(axis=1)
        radius.append(np.sqrt(away.max()))
        if b - a > max(leaf, 1):
            one = held[away.argmax()]
            along = held @ (held[((held - one) ** 2).sum(axis=1).argmax()] - one)
            by = np.argsort(along, kind="stable")
            order[a:b] = order[a:b][by]
            first, last = max(1, (b - a) // 4), max(2, 3 * (b - a) // 4)
            cut = a + first + int(np.diff(along[by])[first - 1 : last - 1].argmax())
            child[node] = len(low)
            low += [a, cut]
            high += [cut, b]
            child += [0, 0]
        node += 1
    return Tree(x[order], ids[order], labels[order], np.array(centre), np.array(radius), np.array(low), np.array(high), np.array(child))


@dataclass(frozen=True)
class Asked:
    """Anchors, and questions about them: the best scores between ``low`` and
    ``high`` of rows whose label equals the anchor's, or differs from it."""

    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same_label: bool


#: An id that loses every tie.
NONE = np.iinfo(np.int64).max


class Best:
    """The k best (score, id) of each question; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), NONE)

    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, question: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k, touched = self.score.shape[1], np.unique(question)
        q = np.concatenate([question, np.repeat(touched, k)])
        s = np.concatenate([score, self.score[touched].ravel()])
        i = np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((i, -s, q))
        first = np.searchsorted(q[order], touched)
        take = order[first[:, None] + np.arange(k)]
        self.score[touched], self.ids[touched] = s[take], i[take]


def search(tree: Tree, asked: Asked, k: int) -> tuple[Best, int]:
    """The k best rows of the tree for each question, and how many leaves were scored for one anchor or more."""
    best, scored = Best(len(asked.anchor), k), 0
    norm = np.sqrt((asked.x**2).sum(axis=1))
    # Rounding of bounds; scores themselves are exact integers.
    slack = 1e-9 * (1.0 + norm * (np.sqrt((tree.centre**2).sum(axis=1)).max() + tree.radius.max()))

    def upper(node: int, questions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        anchors, back = np.unique(asked.anchor[questions], return_inverse=True)
        middle, spread = asked.x[anchors] @ tree.centre[node], norm[anchors] * tree.radius[node] + slack[anchors]
        return (middle + spread)[back], (middle - spread)[back]

    def alive(node: int, questions: np.ndarray) -> tuple[np.ndarray, float]:
        """The questions that the node's ball may answer, and their mean upper bound."""
        above, below = upper(node, questions)
        meets = (above >= asked.low[questions]) & (below <= asked.high[questions]) & (above >= best.kth()[questions])
        return questions[meets], float(above[meets].mean()) if meets.any() else -np.inf

    def score(node: int, questions: np.ndarray) -> None:
        rows = slice(tree.low[node], tree.high[node])
        anchors, back = np.unique(asked.anchor[questions], return_inverse=True)
        found = asked.x[anchors] @ tree.x[rows].T
        fits = (asked.labels[anchors][:, None] == tree.labels[rows]) == asked.same_label
        fits &= asked.ids[anchors][:, None] != tree.ids[rows]
        each, kth, last = found[back], best.kth()[questions], best.ids[questions, -1]
        hit = fits[back] & (each >= asked.low[questions][:, None]) & (each <= asked.high[questions][:, None])
        hit &= (each > kth[:, None]) | ((each == kth[:, None]) & (tree.ids[rows] < last[:, None]))
        q, row = np.nonzero(hit)
        if len(q):
            best.add(questions[q], each[q, row], tree.ids[rows][row])

    waiting = [(0, np.arange(len(asked.anchor)))]
    while waiting:
        node, questions = waiting.pop()
        questions, _ = alive(node, questions)
        if not len(questions):
            continue
        if tree.is_leaf(node):
            scored += 1
            score(node, questions)
            continue
        # The child with the higher bounds is popped first.
        children = [(alive(child, questions), child) for child in (tree.child[node], tree.child[node] + 1)]
        children.sort(key=lambda x: x[0][1])
        waiting.extend((child, met) for (met, _), child in children)
    return best, scored


def _slices(rows: DataFrame, per: DataFrame, t: int, s: Settings) -> DataFrame:
    """Rows with the tree of their label's bucket; a label of more than ``tree`` rows has several trees."""
    slices = per.select("label", F.ceil(F.col("n") / F.lit(s.tree)).cast("int").alias("slices"))
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), "label"), F.lit(t)).cast("int")
    return rows.join(slices, "label").withColumn("bucket", bucket).withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), "id"), F.col("slices")).cast("int"))


def _meet(stored: DataFrame, asked: DataFrame, keys: list[str], k: int, same_label: bool, leaf: int) -> DataFrame:
    """The k best rows of each tree for each question of each block that meets it.

    ``stored``: keys, id, label number l, v. ``asked``: keys, id, l, v, and
    questions, a list of (name, low, high).
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"anchor": [], "name": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            tree = build(matrix(left.column("v")).astype(np.float64), left.column("id").to_numpy(), left.column("l").to_numpy(), leaf)
            questions = right.column("questions").combine_chunks()
            each = questions.flatten()
            anchor = np.repeat(np.arange(right.num_rows), questions.value_lengths().to_numpy())
            name, low, high = (each.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            ids = right.column("id").to_numpy()
            about = Asked(matrix(right.column("v")).astype(np.float64), ids, right.column("l").to_numpy(), anchor, low.astype(np.float64), high.astype(np.float64), same_label)
            best, _ = search(tree, about, k)
            q, place = np.nonzero(best.ids != NONE)
            out = {"anchor": ids[anchor[q]], "name": name[q], "id": best.ids[q, place], "score": best.score[q, place].astype(np.int64)}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(lambda a, b: run(b, a), "anchor long, name long, id long, score long")


def mine(vectors: DataFrame, is_anchor: str, key: str = "vec_id", vector: str = "embedding", label: str = "label", s: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors fulfil ``is_anchor`` over ``id``. A score is the inner product of
    integer vectors; higher ones come first, ties go to the smaller id. An
    anchor's positives are its first other rows of its label; the negatives of
    an anchor and a positive are the first rows of other labels whose score is
    within the window below the positive's. A window that no row fits, as of
    most negative positive scores, gives no row.

    Rows with a null id or label, and with a vector that is null, empty, of
    null or non-finite components or of another length than the most common
    one, take no part. Rows that repeat an id are one: that of the least label,
    then of the least vector. Zero vectors take part. An empty table, or one
    without anchors, gives an empty result. Components so large that a score
    would not be exact in double precision are an error. Other columns are not
    read.
    """
    spark = vectors.sparkSession
    store = Store(spark, "negatives")
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    width = common_width(rows, "v")
    if width is None:
        return empty
    rows = rows.filter(F.size("v") == width)
    size = largest(rows, "v") * s.scale + 1
    if width * size**2 >= 2**53:
        raise ValueError(f"components of up to {size:g} steps are too large for exact scores")
    one = rows.groupBy("id").agg(F.min(F.struct("label", scaled(F.col("v"), s.scale).alias("v"))).alias("r"))
    rows = store.put("rows", one.select("id", "r.label", "r.v"))
    # A label has a number, so that a tree may hold any type of label.
    labels = store.put("labels", rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("l", F.monotonically_increasing_id()))
    # Of equal vectors of a label only the smallest ids can be among the best: one more than the positives, for the anchor itself.
    order = F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))
    least = rows.withColumn("copy", order).filter(F.col("copy") <= max(s.positives + 1, s.negatives))
    stored = store.put("stored", least.join(labels.select("label", "l"), "label").select("id", "label", "l", "v"))
    per = labels.select("label", "n")
    total, asked = stored.count(), store.put("anchors", rows.filter(is_anchor).join(labels.select("label", "l"), "label"))
    n = asked.count()
    if not n:
        return empty
    trees, blocks = max(1, -(-total // s.tree)), max(1, -(-n // s.anchors))

    block = F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).cast("int").alias("block")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("name"), F.lit(-(2**62)).alias("low"), F.lit(2**62).alias("high"))).alias("questions")
    sliced = _slices(stored, per, trees, s)
    home = _slices(asked, per, trees, s).select("bucket", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), block, "id", "l", "v", whole)
    found = _meet(sliced.select("bucket", "slice", every_block, "id", "l", "v"), home, ["bucket", "slice", "block"], s.positives, True, s.leaf)
    best = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    positives = store.put("positives", found.withColumn("rank", best).filter(F.col("rank") <= s.positives).select(F.col("anchor").alias("id"), F.col("id").alias("name"), "score"))

    low, high = -F.floor(-F.col("score") * F.lit(s.low) / F.lit(100)), F.floor(F.col("score") * F.lit(s.high) / F.lit(100))
    window = F.struct("name", low.cast("long").alias("low"), high.cast("long").alias("high"))
    questions = positives.withColumn("w", window).groupBy("id").agg(F.collect_list("w").alias("questions"))  # at most ``positives`` of an anchor
    tree = F.pmod(F.xxhash64(F.lit("tree"), "id"), F.lit(trees)).cast("int").alias("tree")
    every_tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    about = asked.join(questions, "id").select(every_tree, block, "id", "l", "v", "questions")
    found = _meet(stored.select(tree, "id", "l", "v").select("tree", every_block, "id", "l", "v"), about, ["tree", "block"], s.negatives, False, s.leaf)
    best = F.row_number().over(Window.partitionBy("anchor", "name").orderBy(F.desc("score"), "id"))
    found = found.withColumn("rank", best).filter(F.col("rank") <= s.negatives)
    scores = positives.select(F.col("id").alias("anchor"), "name", F.col("score").alias("positive_score"))
    found = found.join(scores, ["anchor", "name"])
    return found.select(F.col("anchor").alias("anchor_id"), F.col("name").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

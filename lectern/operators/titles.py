"""Titles that hold a keyword of a question, for whole tables of both.

A keyword has no blank, so it stands within a word of the title: keywords meet the distinct words of titles, titles take the
keywords of their words, and the pairs, of which there are as many as the answer has rows, are formed in the tasks that give
them on. They are neither joined nor made distinct row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .contains import holding, written

#: Characters of the keys on which keywords and words meet; of the shortest keyword.
KEYS = (12, 6, 3)
#: Questions of a pack, titles that meet it at a time, rows given on at a time; tasks over which a person's titles are dealt.
PACK, STEP, OUT, SPREAD = 8192, 1024, 1 << 17, 32


class Pack:
    """Questions of a pack by their keywords."""

    def __init__(self, pairs: pa.StructArray):
        asked, word = pairs.field("asked").to_numpy(), pairs.field("word").to_numpy()
        self.asked, place = np.unique(asked, return_inverse=True)
        order = np.argsort(word, kind="stable")
        self.words, self.first, self.count = np.unique(word[order], return_index=True, return_counts=True)
        self.place = place[order]

    def met(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(title, place of a question): each title, given by its keywords, with each question that has one of them, once."""
        title, word = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy()), words.flatten().to_numpy()
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        some = self.words[at] == word
        title, at = title[some], at[some]
        n = self.count[at]
        held = np.zeros((len(words), len(self.asked)), bool)
        held[np.repeat(title, n), self.place[np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        return np.nonzero(held)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack: Pack | None = None
    for b in batches:
        cuts = [0, *(np.flatnonzero(b.column("head").to_numpy(zero_copy_only=False)).tolist()), b.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if b.column("head")[low].as_py():
                pack = Pack(b.column("pairs")[low].values)
                low += 1
            for at in range(low, high, STEP):
                part = b.slice(at, min(STEP, high - at))
                title, place = pack.met(part.column("words"))
                items = part.column("item").to_numpy()
                for k in range(0, len(title), OUT):
                    yield pa.RecordBatch.from_arrays([pa.array(pack.asked[place[k : k + OUT]]), pa.array(items[title[k : k + OUT]])], names=["asked", "item_id"])


def holding_keywords(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """(asked, item_id): each question of ``questions(asked, person, kw)`` with each item of ``titles(item_id, person, low)``
    of its person that has one of its keywords in its title, once.

    Keywords have three characters or more and no blank; repeated rows, and several titles of an item, count once. Rows with
    a null meet none.
    """
    questions = written(questions.where("asked is not null and person is not null and kw is not null").distinct(), "keywords")
    words = written(questions.select("person", "kw").distinct().withColumn("word", F.monotonically_increasing_id()), "words")
    token = titles.select("item_id", "person", F.explode(F.array_distinct(F.split("low", " "))).alias("token"))
    tokens = written(token.where(f"item_id is not null and person is not null and length(token) >= {KEYS[-1]}").distinct(), "title-words")
    found = holding(words, tokens.select("person", "token").distinct(), "kw", "token", KEYS).groupBy("person", "token").agg(F.collect_list("word").alias("words"))
    held = tokens.join(found, ["person", "token"]).groupBy("person", "item_id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    # an item or question of several people may meet the same one twice
    several = [t.select(c, "person").distinct().groupBy(c).count().where("count > 1").select(c, F.lit(True).alias("several")) for t, c in ((questions, "asked"), (titles, "item_id"))]
    held = written(held.join(several[1], "item_id", "left").withColumn("several", F.coalesce("several", F.lit(False))), "titles-held")
    dealt = questions.join(words, ["person", "kw"]).join(several[0], "asked", "left")
    per = dealt.groupBy("person").agg(F.ceil(F.countDistinct("asked") / PACK).alias("packs"))
    packs = dealt.join(F.broadcast(per), "person").withColumn("pack", F.expr("pmod(xxhash64(asked), packs)"))  # a row a person
    packs = written(packs.groupBy("person", "pack").agg(F.collect_list(F.struct("asked", "word")).alias("pairs"), F.max(F.coalesce("several", F.lit(False))).alias("several")), "packs")
    out = []
    for again in (False, True):
        titles_ = held.where("several" if again else "not several")
        heads = packs.select("person", "pack", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"), F.lit(True).alias("head"), "pairs", F.lit(None).cast("long").alias("item"), F.lit(None).cast("array<long>").alias("words"))
        rows = titles_.join(F.broadcast(packs.select("person", "pack")), "person")  # a row a pack of 8192 questions
        rows = rows.select("person", "pack", F.expr(f"cast(pmod(xxhash64(item_id), {SPREAD}) as int)").alias("salt"), F.lit(False).alias("head"), F.lit(None).cast(packs.schema["pairs"].dataType).alias("pairs"), F.col("item_id").alias("item"), "words")
        every = heads.unionByName(rows).repartition("person", "pack", "salt").sortWithinPartitions("person", "pack", "salt", F.desc("head"))
        pairs = every.select("head", "pairs", "item", "words").mapInArrow(_pairs, "asked long, item_id long")
        out.append(pairs.distinct() if again else pairs)
    return out[0].unionByName(out[1])

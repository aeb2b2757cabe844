"""Requests to outside services: packing by a budget, request lines, answers, retries and a client in the tasks."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_fit(sizes: list[int], budget: int) -> list[list[int]]:
    bins: list[list[int]] = []
    room = 0
    for s in sizes:
        if not bins or s > room:
            bins.append([])
            room = budget
        bins[-1].append(s)
        room -= s
    return bins


class Rooms:
    """The room left in up to n bins, and the first bin with enough of it: a tree of greatest rooms, so a search takes log n."""

    def __init__(self, n: int, budget: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.tree = [budget] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """The first bin that has room for ``size``, which it then has less."""
        i = 1
        while i < self.leaves:
            i = 2 * i if self.tree[2 * i] >= size else 2 * i + 1
        at = i - self.leaves
        self.tree[i] -= size
        while i > 1:
            i //= 2
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])
        return at


def first_fit_decreasing(sizes: list[int], budget: int) -> list[list[int]]:
    """Sizes above the budget are left out."""
    kept = sorted((x for x in sizes if x <= budget), reverse=True)
    rooms, bins = Rooms(len(kept), budget), []
    for s in kept:
        i = rooms.take(s)
        if i == len(bins):
            bins.append([])
        bins[i].append(s)
    return bins


def best_fit(sizes: list[int], budget: int) -> list[list[int]]:
    bins, rooms = [], []
    for s in sizes:
        fits = [(room - s, i) for i, room in enumerate(rooms) if s <= room]
        if fits:
            i = min(fits)[1]
            bins[i].append(s)
            rooms[i] -= s
        else:
            bins.append([s])
            rooms.append(budget - s)
    return bins


def pack_rows(df: DataFrame, key: str, size: str, budget: int, block_rows: int = 5000) -> DataFrame:
    """First-fit decreasing in blocks of rows by hash: key, size, block, bin. Rows above the budget have a null bin.

    A block is all that one task packs; the last bin of each block may be less full than a global packing's.
    """
    blocks = 1 + df.count() // block_rows
    rows = df.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "key"], ascending=[False, True], ignore_index=True)
        rooms = Rooms(len(part), budget)
        bins = [None if s > budget else rooms.take(s) for s in part["size"]]
        return part.assign(bin=pd.array(bins, "Int32"))

    return rows.groupBy("block").applyInPandas(packed, "key long, size long, block int, bin int")


def fixed_groups(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows in groups of n consecutive numbers of the key: ``task``. The key numbers the rows, so nothing is sorted."""
    return df.withColumn("task", F.floor(F.col(order) / n).cast("long"))


def request_lines(df: DataFrame, key: str, text: str, system: str, model: str, **options: object) -> DataFrame:
    """One JSON request for each row."""
    message = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), F.col(text).alias("content")))
    body = F.struct(F.lit(model).alias("model"), message.alias("messages"), *(F.lit(v).alias(k) for k, v in options.items()))
    return df.select(F.to_json(F.struct(F.col(key).cast("string").alias("custom_id"), body.alias("body"))).alias("value"))


def parse_answers(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Answers with five named fields (N/A where one is missing), and the lines that cannot be read."""
    fields = ("biome_label", "geo_location", "keywords", "sub_biome")
    content = F.get_json_object(value, "$.content")
    rows = lines.select(F.get_json_object(value, "$.custom_id").alias("sample_id"), F.try_parse_json(content).isNotNull().alias("_ok"), *(F.coalesce(F.get_json_object(content, f"$.{f}"), F.lit("N/A")).alias(f) for f in fields), F.col(value))
    good = F.col("sample_id").isNotNull() & F.coalesce(F.col("_ok"), F.lit(False))
    return rows.filter(good).select("sample_id", *fields), rows.filter(~good).select(value)


class RateWindow:
    """At most ``most`` calls in any ``seconds`` of one task."""

    def __init__(self, most: int, seconds: float = 60, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most, self.seconds, self.clock, self.sleep, self.calls = most, seconds, clock, sleep, deque()

    def wait(self) -> None:
        now = self.clock()
        while self.calls and now - self.calls[0] >= self.seconds:
            self.calls.popleft()
        if len(self.calls) >= self.most:
            self.sleep(self.seconds - (now - self.calls[0]))
            self.calls.popleft()
        self.calls.append(self.clock())


def with_retries(call: Callable[[], list[str]], retries: int, wait: float, sleep: Callable[[float], None] = time.sleep) -> tuple[list[str] | None, str | None]:
    """The answers, or the last error after so many further tries; waits double from try to try."""
    for i in range(retries + 1):
        try:
            return call(), None
        except Exception as e:  # the service's errors are data here
            error = str(e)
            if i < retries:
                sleep(wait * 2**i)
    return None, error


def call_service(df: DataFrame, key: str, text: str, client: Callable[[list[str]], list[str]], batch: int = 20, most_per_minute: int = 0, retries: int = 2, wait: float = 0.5) -> DataFrame:
    """key, answer and error of each row; a batch that fails again and again leaves rows with an error, none is lost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit = RateWindow(most_per_minute) if most_per_minute else None
        for rows in batches:
            for lo in range(0, len(rows), batch):
                part = rows.iloc[lo : lo + batch]
                if limit:
                    limit.wait()
                answers, error = with_retries(lambda p=part: client(list(p[text])), retries, wait)
                answers = [None] * len(part) if answers is None else answers
                yield pd.DataFrame({key: part[key], "answer": answers, "error": error})

    return df.select(F.col(key).cast("string").alias(key), text).mapInPandas(run, f"{key} string, answer string, error string")


def retry_missing(requested: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    return requested.join(answered.select(key), key, "left_anti")


def latest_answers(answers: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the answer that came last."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return answers.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

"""Landed REST pages as a Python data source: one partition a month, pages of JSON posts.

    spark.dataSource.register(MonthlyPosts)
    spark.read.format("monthly_posts").option("path", folder).option("start", "2024-01-15").option("end", "2024-06-01").load()

A month is read as a unit: its files ``<month>*.json`` in order, each a list of posts, until two empty pages. A post's
id counts once in a month; months are half-open, so a post stamped at a boundary belongs to the later one.
"""

from __future__ import annotations

import datetime
import glob
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id long, link string, title string, content string, date string, month string"


class Month(InputPartition):
    def __init__(self, label: str, start: str, stop: str):
        self.label, self.start, self.stop = label, start, stop


def months(start: str, end: str) -> list[Month]:
    a, b = datetime.date.fromisoformat(start), datetime.date.fromisoformat(end)
    out, first = [], a.replace(day=1)
    while first < b:
        after = (first.replace(day=28) + datetime.timedelta(days=4)).replace(day=1)
        out.append(Month(first.strftime("%Y-%m"), max(a, first).isoformat(), min(after, b).isoformat()))
        first = after
    return out[::-1]


class PostReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return months(self.options["start"], self.options["end"])

    def read(self, partition):
        seen, empty = set(), 0
        for name in sorted(glob.glob(os.path.join(self.options["path"], f"{partition.label}*.json"))):
            with open(name, encoding="utf-8") as f:
                posts = json.load(f)
            empty = 0 if posts else empty + 1
            if empty == 2:
                return
            for p in posts:
                if p["id"] not in seen and partition.start <= p["date"] < partition.stop:
                    seen.add(p["id"])
                    yield (p["id"], p.get("link", ""), p.get("title", {}).get("rendered", ""), p.get("content", {}).get("rendered", ""), p["date"], partition.label)


class MonthlyPosts(DataSource):
    @classmethod
    def name(cls):
        return "monthly_posts"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PostReader(self.options)

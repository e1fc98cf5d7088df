"""Vector stores that are read page by page, as a Python data source.

Offset stores are split into ranges of pages that executors read on their own; token stores have a chain of tokens and so one
reader.  A store's client is made on the executor by a factory; the defaults import the store's own library.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.cloudpickle import dumps, loads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from verispark.schemas import CHUNK

Row = tuple


def _row(id_: Any, text: Any, vector: Any, metadata: dict | None, at: Any) -> Row:
    return (None if id_ is None else str(id_), text, None if vector is None else [float(x) for x in vector], {str(k): str(v) for k, v in (metadata or {}).items()}, None if at is None else str(at))


def chroma_client(collection: str, path: str | None = None, host: str | None = None, port: int = 8000, **_: Any):
    import chromadb

    return (chromadb.HttpClient(host=host, port=port) if host else chromadb.PersistentClient(path=path)).get_collection(collection)


def chroma_page(client: Any, offset: int, size: int, **_: Any) -> list[Row]:
    got = client.get(limit=size, offset=offset, include=["documents", "embeddings", "metadatas"])
    empty = [None] * len(got["ids"])
    cols = [got[k] if got.get(k) is not None else empty for k in ("documents", "embeddings", "metadatas")]
    return [_row(i, t, v, m, (m or {}).get("ingested_at") or (m or {}).get("created_at")) for i, t, v, m in zip(got["ids"], *cols, strict=True)]


def milvus_client(collection: str, uri: str, **_: Any):
    from pymilvus import MilvusClient

    return MilvusClient(uri=uri)


def milvus_page(client: Any, offset: int, size: int, collection: str = "", text_field: str = "text", vector_field: str = "vector", **_: Any) -> list[Row]:
    rows = client.query(collection_name=collection, filter="", output_fields=["*"], limit=size, offset=offset)
    known = {"id", "pk", text_field, vector_field}
    named = lambda r, i: r.get("id", r.get("pk", f"milvus-{offset + i}"))
    return [_row(named(r, i), r.get(text_field), r.get(vector_field), {k: v for k, v in r.items() if k not in known}, None) for i, r in enumerate(rows)]


def milvus_count(client: Any, collection: str = "", **_: Any) -> int:
    return int(client.get_collection_stats(collection_name=collection)["row_count"])


def pinecone_client(index: str, api_key: str | None = None, **_: Any):
    from pinecone import Pinecone

    return Pinecone(api_key=api_key).Index(index)


def pinecone_pages(client: Any, size: int, namespace: str = "", **_: Any) -> Iterator[list[Row]]:
    token = None
    while True:
        page = client.list_paginated(namespace=namespace, limit=size, pagination_token=token)
        ids = [v["id"] if isinstance(v, dict) else v.id for v in page["vectors"]]
        got = client.fetch(ids=ids, namespace=namespace)["vectors"] if ids else {}
        rows = []
        for i in ids:
            v = got.get(i, {})
            m = dict(v.get("metadata") or {})
            rows.append(_row(i, m.get("text", m.get("content")), v.get("values"), m, m.get("ingested_at")))
        yield rows
        token = (page.get("pagination") or {}).get("next")
        if not token:
            return


#: kind: (client factory, reader of one page by offset, reader of all pages in turn, count, rows in a page).
STORES: dict[str, tuple[Callable, Callable | None, Callable | None, Callable | None, int]] = {
    "chroma": (chroma_client, chroma_page, None, lambda c, **_: c.count(), 500),
    "milvus": (milvus_client, milvus_page, None, milvus_count, 500),
    "pinecone": (pinecone_client, None, pinecone_pages, None, 100),
}


class _Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kind, self.config = options["kind"], json.loads(options["config"])
        self.factory = loads(bytes.fromhex(options["factory"]))
        _, self.page, self.pages, self.count, size = STORES[self.kind]
        self.size = int(options.get("batchsize", size))
        self.splits = int(options.get("splits", 8))
        self.limit = int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[InputPartition]:
        if self.pages:
            return [_Pages(0, -1)]
        total = self.count(self.factory(**self.config), **self.config)
        total = total if self.limit is None else min(total, self.limit)
        step = -(-max(1, -(-total // self.size)) // self.splits) * self.size
        return [_Pages(a, min(a + step, total)) for a in range(0, total, step)] or [_Pages(0, 0)]

    def read(self, part: _Pages) -> Iterator[Row]:
        client = self.factory(**self.config)
        if self.pages:
            left = self.limit
            for rows in self.pages(client, self.size, **self.config) if left != 0 else ():
                for r in rows:
                    yield r
                    left = None if left is None else left - 1
                    if left == 0:
                        return
            return
        for a in range(part.first, part.last, self.size):
            yield from self.page(client, a, min(self.size, part.last - a), **self.config)


class PagedStore(DataSource):
    """Options: kind, config (JSON for client and pages), factory (pickled), batchsize, splits, limit."""

    @classmethod
    def name(cls) -> str:
        return "paged_store"

    def schema(self) -> str:
        return CHUNK

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def from_store(spark: SparkSession, kind: str, client: Callable | None = None, batch_size: int | None = None, limit: int | None = None, splits: int = 8, **config: Any) -> DataFrame:
    """All chunks of a store.  client: own factory, called with the configuration."""
    spark.dataSource.register(PagedStore)
    options = {"kind": kind, "config": json.dumps(config), "factory": dumps(client or STORES[kind][0]).hex(), "splits": str(splits)}
    options |= {"batchsize": str(batch_size)} if batch_size else {}
    options |= {"limit": str(limit)} if limit is not None else {}
    return spark.read.format("paged_store").options(**options).load()

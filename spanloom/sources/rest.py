"""Paginated services as a Spark data source, with clients that can be put in.

A client is a callable ``fetch(kind, params) -> dict`` with ``items`` and perhaps
``nextPageToken``; it raises ``HttpError`` with a status. Each key (channel or video) is
a partition, so keys are read in parallel and a lost task reads its key again.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class HttpError(Exception):
    """A failed request."""

    def __init__(self, status: int, reason: str = ""):
        super().__init__(f"{status} {reason}".strip())
        self.status, self.reason = status, reason


def with_retry(call: Callable[[], dict], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> dict:
    """Call again after a 403 (but not where comments are off), waiting 2, 4, 8 seconds; then raise."""
    for attempt in range(attempts):
        try:
            return call()
        except HttpError as e:
            if e.status != 403 or "commentsDisabled" in e.reason or attempt + 1 == attempts:
                raise
            wait(2.0 ** (attempt + 1))
    raise AssertionError("unreachable")


def pages(fetch: Callable[[str, dict], dict], kind: str, params: dict, page_size: int, most: int | None = None, most_pages: int | None = None, wait=time.sleep) -> Iterator[dict]:
    """Items of all pages up to the caps."""
    token, given, read = None, 0, 0
    while True:
        size = page_size if most is None else min(page_size, most - given)
        if size <= 0 or (most_pages is not None and read >= most_pages):
            return
        page = with_retry(lambda: fetch(kind, params | {"maxResults": size, "pageToken": token}), wait=wait)
        read += 1
        for item in page.get("items", []):
            yield item
            given += 1
            if most is not None and given >= most:
                return
        token = page.get("nextPageToken")
        if not token:
            return


def channel_videos(fetch, channel_id: str, most: int = 50, wait=time.sleep) -> Iterator[dict]:
    """A channel's uploads, from their playlist; where that is missing (404), from a search."""
    try:
        yield from pages(fetch, "playlistItems", {"playlistId": "UU" + channel_id[2:]}, 50, most, wait=wait)
    except HttpError as e:
        if e.status != 404:
            raise
        yield from pages(fetch, "search", {"channelId": channel_id, "type": "video", "order": "date"}, 50, most, wait=wait)


def video_threads(fetch, video_id: str, most: int = 200, most_pages: int | None = None, wait=time.sleep) -> Iterator[dict]:
    """A video's comment threads; none where comments are off or forbidden."""
    try:
        yield from pages(fetch, "commentThreads", {"videoId": video_id, "part": "snippet,replies"}, 100, most, most_pages, wait)
    except HttpError as e:
        if e.status != 403:
            raise


def batches(ids: list[str], size: int = 50) -> Iterator[list[str]]:
    """Ids in groups of what one request may ask for."""
    return (ids[i : i + size] for i in range(0, len(ids), size))


def channel_details(fetch, ids: list[str], wait=time.sleep) -> Iterator[dict]:
    for group in batches(ids):
        yield from pages(fetch, "channels", {"id": ",".join(group)}, 50, wait=wait)


def channel_search(fetch, query: str, most: int = 50, wait=time.sleep) -> Iterator[dict]:
    """Channels that a search finds."""
    yield from pages(fetch, "search", {"q": query, "type": "channel"}, 50, most, wait=wait)


_READ = {
    "videos": channel_videos,
    "threads": video_threads,
    "search": channel_search,
    "details": lambda fetch, ids, most: channel_details(fetch, ids.split(",")),
}


def _client(dotted: str) -> Callable[[str, dict], dict]:
    module, _, name = dotted.rpartition(".")
    return getattr(importlib.import_module(module), name)


class _Key(InputPartition):
    def __init__(self, key: str):
        super().__init__(key)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        keys = json.loads(self.options["keys"])
        return [_Key(k) for k in (map(",".join, batches(keys)) if self.options["kind"] == "details" else keys)]

    def read(self, partition):
        fetch = _client(self.options["client"])
        for item in _READ[self.options["kind"]](fetch, partition.value, int(self.options.get("most", 50))):
            yield partition.value, json.dumps(item, ensure_ascii=False)


#: What is asked for each key of a stream: the service's kind of request, and the name of the parameter that holds the key.
_STREAMED = {"threads": ("commentThreads", "videoId"), "search": ("search", "q"), "videos": ("playlistItems", "playlistId")}


class _Page(InputPartition):
    def __init__(self, key: str, token: str):
        super().__init__((key, token))


class _StreamReader(DataSourceStreamReader):
    """Pages of all keys as a stream. An offset has each key's next page token (none once it is read through) and the pages of its batch.

    So a batch that is made again asks for the same pages, and a query that is started again goes on behind the last ones. A trigger
    admits ``pages`` pages at most, dealt to the keys in turn. To plan them the driver asks for a page's
    following token only; the pages themselves are read by the tasks, one each.
    """

    def __init__(self, options: dict):
        self.keys, self.admitted = json.loads(options["keys"]), int(options.get("pages", 10))
        self.size = int(options.get("page_size", 50))
        self.kind, self.name = _STREAMED[options["kind"]]
        self.client, self.now = options["client"], None

    def ask(self, key: str, token: str, **more) -> dict:
        params = {self.name: key, "maxResults": self.size, "pageToken": token or None} | more
        return with_retry(lambda: _client(self.client)(self.kind, params))

    def initialOffset(self) -> dict:
        return {"next": {k: "" for k in self.keys}, "pages": []}

    def latestOffset(self) -> dict:
        now = self.now or self.initialOffset()
        following, taken = dict(now["next"]), []
        for key in self.keys:  # keys that the checkpoint doesn't know yet
            following.setdefault(key, "")
        while len(taken) < self.admitted and (open_keys := [k for k in self.keys if following[k] is not None]):
            for key in open_keys[: self.admitted - len(taken)]:
                try:
                    token = self.ask(key, following[key], fields="nextPageToken").get("nextPageToken")
                except HttpError as e:
                    if e.status not in (403, 404):
                        raise
                    following[key] = None  # forbidden or missing: nothing to read
                    continue
                taken.append([key, following[key]])
                following[key] = token or None
        if taken or following != now["next"]:
            self.now = {"next": following, "pages": taken}
        return self.now or now

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        # After a restart Spark plans the last batch once more, which tells where the stream is.
        self.now = self.now or end
        return [_Page(k, t) for k, t in end["pages"]]

    def read(self, partition: _Page) -> Iterator[tuple[str, str]]:
        key, token = partition.value
        for item in self.ask(key, token).get("items", []):
            yield key, json.dumps(item, ensure_ascii=False)


class PagedSource(DataSource):
    """``spark.read.format("paged")`` with options ``kind`` (videos, threads, search, details), ``keys`` (JSON list), ``client`` (dotted name) and ``most``.

    ``spark.readStream`` takes kinds videos (keys are playlists), threads and search, and ``pages`` (a trigger) and ``page_size`` for ``most``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "key string, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)

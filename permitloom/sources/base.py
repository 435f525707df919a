"""What a source is."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file that are held at once.
CHUNK = 8 << 20


@runtime_checkable
class Source(Protocol):
    """Anything with a name that yields a table."""

    name: str

    def fetch(self, spark: SparkSession) -> DataFrame: ...


class Client(Protocol):
    """What sources ask of the network."""

    def get_json(self, path: str, params: dict[str, Any]) -> Any: ...

    def stream(self, url: str) -> Iterator[bytes]: ...

    def options(self) -> dict[str, str]:
        """What a reader on an executor needs to ask the same."""
        ...


class HttpClient:
    """The portal over HTTP.

    Failures of the server or the way to it are tried again, ``retries`` times, after ``wait`` seconds and twice as
    long each time; answers that the request is wrong (4xx, but for 429) are raised at once.
    """

    def __init__(self, base: str, timeout: float = 120.0, retries: int = 4, wait: float = 0.5):
        self.base, self.timeout, self.retries, self.wait = base, timeout, retries, wait

    @staticmethod
    def of(options: dict[str, str]) -> HttpClient:
        numbers = {k: kind(options[k]) for k, kind in (("timeout", float), ("retries", int), ("wait", float)) if k in options}
        return HttpClient(options["url"], **numbers)

    def options(self) -> dict[str, str]:
        return {"url": self.base, "timeout": str(self.timeout), "retries": str(self.retries), "wait": str(self.wait)}

    def _opened(self, url: str, start: int = 0):
        ask = urllib.request.Request(url if "://" in url else self.base + url, headers={"Range": f"bytes={start}-"} if start else {})
        for k in range(self.retries + 1):
            try:
                return urllib.request.urlopen(ask, timeout=self.timeout)
            except urllib.error.HTTPError as why:
                if k == self.retries or (why.code < 500 and why.code != 429):
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if k == self.retries:
                    raise
            time.sleep(self.wait * 2**k)

    def stream(self, url: str) -> Iterator[bytes]:
        """A file, ``CHUNK`` bytes at a time; where it breaks off, the rest is asked for."""
        done, broken = 0, 0
        while True:
            with self._opened(url, done) as answer:
                if done and answer.status != 206:
                    raise ConnectionError(f"{url} broke off and can't be continued")
                length = answer.headers.get("Content-Length")
                whole = None if length is None else done + int(length)
                try:
                    while part := answer.read(CHUNK):
                        done += len(part)
                        yield part
                except (OSError, TimeoutError):
                    pass
            if whole is None or done >= whole:
                return
            broken += 1
            if broken > self.retries:
                raise ConnectionError(f"{url} broke off after {done} of {whole} bytes")

    def get_json(self, path: str, params: dict[str, Any]) -> Any:
        with self._opened(f"{path}?{urllib.parse.urlencode(params)}") as answer:
            return json.loads(answer.read())

"""A portal on this machine, over HTTP: what the sources ask for, from callables or from files that Spark wrote."""

from __future__ import annotations

import json
import threading
import urllib.parse
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from permitloom.sources.base import HttpClient
from permitloom.sources.paged import RECORDS


class LocalPortal:
    """Serves resources, pages of records (JSON texts by offset and limit), and files (parts by path).

    ``total`` is told where it is known.  ``before`` sees each request's path and parameters, and may answer with an HTTP status instead.
    """

    def __init__(self, resources: list[dict], page_of: Callable[[int, int], list[str]] = lambda offset, limit: [], total: int | None = None, files: Callable[[str], Iterator[bytes]] | None = None, before: Callable[[str, dict], int | None] = lambda path, ask: None):
        self.asked: list[tuple[str, dict]] = []
        portal = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                path, _, query = self.path.partition("?")
                ask = dict(urllib.parse.parse_qsl(query))
                portal.asked.append((path, ask))
                if (status := before(path, ask)) is not None:
                    self.send_error(status)
                    return
                if path == RECORDS:
                    records = page_of(int(ask["offset"]), int(ask["limit"])) if int(ask["limit"]) else []
                    about = "" if total is None else f'"total": {total}, '
                    parts = iter([f'{{"result": {{{about}"records": [{", ".join(records)}]}}}}'.encode()])
                elif path.startswith("/api/"):
                    parts = iter([json.dumps({"result": {"resources": resources}}).encode()])
                else:
                    parts = files(path)
                self.send_response(200)
                self.end_headers()
                for part in parts:
                    self.wfile.write(part)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.client = HttpClient(f"http://127.0.0.1:{self.server.server_port}", retries=2, wait=0.01)

    def __enter__(self) -> LocalPortal:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *why) -> None:
        self.server.shutdown()
        self.server.server_close()

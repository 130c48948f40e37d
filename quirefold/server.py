"""Queries over HTTP and over a Unix socket."""

from __future__ import annotations

import logging
import re
import socketserver
import threading
import uuid
from collections.abc import Callable, Iterable
from datetime import timezone
from email.utils import format_datetime, parsedate_to_datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain
from tempfile import SpooledTemporaryFile
from typing import BinaryIO
from urllib.parse import parse_qs, urlsplit

from quirefold.api import Corpus
from quirefold.lang.parser import QueryError
from quirefold.sinks import outputs

#: The bytes that frame a message on the socket, and the time one query has.
START_HEADER, START_BODY, END_BODY, END_MESSAGE, END_QUERY = b"\x01", b"\x02", b"\x03", b"\x04", b"\x05"
TIMEOUT_S = 0.4
#: Fixed value: how long a server that ends waits for the queries it still answers.
GRACE_S = 5.0


#: A corpus, or what gives the one to ask: a store's latest version at each query.
Source = Corpus | Callable[[], Corpus]


def current(source: Source) -> Corpus:
    return source() if callable(source) else source


def run_for(corpus: Corpus, seconds: float | None, work):
    """`work()` on Spark; jobs that take longer than `seconds` are cancelled, and TimeoutError raised."""
    context = corpus.docs.sparkSession.sparkContext
    if seconds is None:
        return work()
    tag, late = f"q{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        return work()
    except Exception as e:
        if late.is_set():
            raise TimeoutError("the query took too long") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def spool(pieces: Iterable[str]) -> tuple[int, BinaryIO]:
    """How many pieces there are, and all of them: their number has to be sent first. What is over a megabyte is on disk."""
    body, n = SpooledTemporaryFile(1 << 20), 0
    for n, piece in enumerate(pieces, 1):
        body.write(piece.encode())
    body.seek(0)
    return n, body


def http_handler(source: Source) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args) -> None:
            pass

        def _reply(self, status: int, body: bytes, kind: str = "text/plain; charset=utf-8", modified=None) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            if modified:
                self.send_header("Last-Modified", format_datetime(modified, usegmt=True))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            self._reply(200, b"POST a query to /search\n")

        def do_POST(self) -> None:
            url = urlsplit(self.path)
            params = parse_qs(url.query)
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            if url.path != "/search":
                self._reply(404, b"not found")
                return
            text = params.get("query", [""])[0] or raw
            # A form field is taken apart; a bare query sent with the type of a form is not.
            if "x-www-form-urlencoded" in (self.headers.get("Content-Type") or "") and re.match(r"(?:[^=&]*&)*query=", raw):
                text = parse_qs(raw).get("query", [raw])[0]
            try:
                found = current(source).query(text)
            except QueryError as e:
                self._reply(400, str(e).encode())
                return
            try:
                order = params.get("sortOrder", [""])[0]
                rows = found.sort(params.get("sortBy", [None])[0], order in ("desc", "descending"))
                last = found.last_modified().first()["last_modified"]
                last = last.replace(tzinfo=timezone.utc) if last else None
                since = self.headers.get("If-Modified-Since")
                if last and since and last <= parsedate_to_datetime(since):
                    self.send_response(304)
                    self.send_header("Content-Length", "0")
                    self.end_headers()
                    return
                pieces = outputs.stream(rows.docs, "json")
                first = next(pieces)
            except Exception:
                self._reply(500, b"Error executing query")
                return
            self._stream(chain([first], pieces), last)

        def _stream(self, pieces, modified) -> None:
            """A reply in chunks: one partition of the result is in memory at a time. An error on the way ends the connection."""
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            chunked = self.request_version != "HTTP/1.0"
            self.send_header(*(("Transfer-Encoding", "chunked") if chunked else ("Connection", "close")))
            if modified:
                self.send_header("Last-Modified", format_datetime(modified, usegmt=True))
            self.end_headers()
            self.close_connection = not chunked
            try:
                for piece in pieces:
                    data = piece.encode()
                    self.wfile.write(b"%x\r\n%b\r\n" % (len(data), data) if chunked else data)
                if chunked:
                    self.wfile.write(b"0\r\n\r\n")
            except Exception:
                self.close_connection = True

    return Handler


class Draining:
    """Counts the requests in work, so that a server that ends can wait for them."""

    def __init__(self, *args) -> None:
        self._working, self._idle = 0, threading.Condition()
        super().__init__(*args)

    def process_request_thread(self, request, client_address) -> None:
        with self._idle:
            self._working += 1
        try:
            super().process_request_thread(request, client_address)
        finally:
            with self._idle:
                self._working -= 1
                self._idle.notify_all()

    def drain(self, seconds: float = GRACE_S) -> bool:
        """Wait until no request is in work, `seconds` at most; whether that was reached."""
        with self._idle:
            return self._idle.wait_for(lambda: not self._working, seconds)


class HttpServer(Draining, ThreadingHTTPServer):
    pass


def serve_http(source: Source, address: str = "127.0.0.1", port: int = 8080) -> HttpServer:
    """A server that is ready; serve_forever() runs it, shutdown() ends it, drain() waits for what it still answers."""
    return HttpServer((address, port), http_handler(source))


def socket_handler(source: Source, timeout: float | None = TIMEOUT_S) -> type[socketserver.BaseRequestHandler]:
    class Handler(socketserver.BaseRequestHandler):
        def handle(self) -> None:
            pending = b""
            while True:
                part = self.request.recv(1024)
                if not part:
                    return
                *queries, pending = (pending + part).split(END_QUERY)
                for q in queries:
                    if not self._answer(q.decode("utf-8", "replace")):
                        return

        def _error(self, message: str) -> bool:
            self.request.sendall(START_HEADER + b"Error handling query" + START_BODY + END_BODY + message.encode() + END_MESSAGE)
            return False

        def _answer(self, text: str) -> bool:
            try:
                corpus = current(source)
                found = corpus.query(text)
            except QueryError:
                return self._error("query compilation error")
            try:
                n, body = run_for(corpus, timeout, lambda: spool(outputs.stream(found.docs)))
            except Exception:
                return self._error("query execution error")
            with body:
                self.request.sendall(START_HEADER + f"Num Docs: {n}".encode() + START_BODY)
                while part := body.read(1 << 16):
                    self.request.sendall(part)
            self.request.sendall(END_BODY + END_MESSAGE)
            return True

    return Handler


class _UnixServer(Draining, socketserver.ThreadingMixIn, socketserver.UnixStreamServer):
    daemon_threads = True


def serve_unix(source: Source, path: str, timeout: float | None = TIMEOUT_S) -> _UnixServer:
    return _UnixServer(path, socket_handler(source, timeout))


def every(seconds: float, work) -> threading.Event:
    """Run `work` again and again in the background until the event that is returned is set."""
    stop = threading.Event()

    def loop() -> None:
        while not stop.wait(seconds):
            try:
                work()
            except Exception:
                logging.exception("periodic work failed")

    threading.Thread(target=loop, daemon=True).start()
    return stop

"""/metrics and /healthz of a store, from one thread."""

from __future__ import annotations

import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer


def serve(metrics: Callable[[], str], port: int = 0, host: str = "127.0.0.1") -> HTTPServer:
    """Serves ``metrics()`` until ``shutdown()``; other paths are 404."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            body = {"/metrics": metrics, "/healthz": lambda: "ok\n"}.get(self.path.split("?")[0])
            said = (body() if body else "not found\n").encode()
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.send_header("Content-Length", str(len(said)))
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *_: object) -> None:
            pass

    server = HTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server

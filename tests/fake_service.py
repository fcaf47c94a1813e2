"""A small HTTP service on this machine, and an opener that leads addresses on p<port>.example.org to it."""

import http.client
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import urlsplit


def opener(url, post=None):
    parts = urlsplit(url)
    c = http.client.HTTPConnection("127.0.0.1", int(parts.hostname.split(".")[0][1:]), timeout=10)
    c.request("GET" if post is None else "POST", parts.path, post)
    reply = c.getresponse()
    return reply.status, {k.lower(): v for k, v in reply.getheaders()}, [reply.read()]


class Service:
    """answers: path -> bytes, or a function of the posted text; the first calls of paths in `limited` get status 429."""

    def __init__(self, answers, limited=()):
        self.calls, self.limited, lock = Counter(), dict.fromkeys(limited, 1), threading.Lock()

        class Handler(BaseHTTPRequestHandler):
            def do_GET(handler):  # noqa: N805
                posted = handler.rfile.read(int(handler.headers.get("content-length") or 0)).decode()
                with lock:
                    self.calls[handler.path] += 1
                    refused = self.limited.get(handler.path, 0) > 0
                    if refused:
                        self.limited[handler.path] -= 1
                found = answers.get(handler.path)
                body = b"" if refused or found is None else found(posted) if callable(found) else found
                handler.send_response(429 if refused else 404 if found is None else 200)
                if refused:
                    handler.send_header("retry-after", "0")
                handler.send_header("content-length", str(len(body)))
                handler.end_headers()
                handler.wfile.write(body)

            do_POST = do_GET

            def log_message(handler, *_):  # noqa: N805
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.base = f"https://p{self.server.server_port}.example.org"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def close(self):
        self.server.shutdown()


def rate(prompt):
    """A scorer that finds one thing."""
    return '{"dimensions": [{"name": "obfuscation", "score": 4, "confidence": "1", "reasoning": "r"}], "summary": "seen"}'

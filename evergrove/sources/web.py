"""Web calls of the language, ``my.computer.network.web.<name>(...)``: requests to
other services, and answers to requests in the inbound queue.

An outbound call is a value of its program, made on the driver; a body is read
up to ``MAX_BODY`` bytes and is unknown beyond.
"""

from __future__ import annotations

import socket
import ssl
import time
import urllib.error
import urllib.request

from evergrove.functions import model
from evergrove.functions.model import Unknown

PREFIX = "my.computer.network.web."
REQUESTS = "my.computer.network.web.requests"
METHODS = ("get", "post", "put", "patch", "delete")
TIMEOUT_MS = 30_000
MAX_BODY = 16 << 20


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def call(method: str, args: list):
    """A record of status, body, headers, time and duration (ms), or why not."""
    with_body = method in ("post", "put", "patch")
    least = 2 if with_body else 1
    if not least <= len(args) <= least + 1:
        return Unknown(f"{method}() expects {least} or {least + 1} arguments ({'url, body' if with_body else 'url'} [, options])")
    options = args[least] if len(args) > least else {}
    if not isinstance(args[0], str) or not isinstance(options, dict):
        return Unknown(f"{method}() expects a text and a record")
    headers = options.get("headers", {})
    if not isinstance(headers, dict) or not all(isinstance(v, str) for v in headers.values()):
        return Unknown("header values must be text" if isinstance(headers, dict) else "headers option must be a record")
    if not args[0].startswith(("http://", "https://")):
        return Unknown(f"invalid_url: {args[0]}")
    body = None
    if with_body:
        body = (args[1] if isinstance(args[1], str) else model.to_json(args[1])).encode()
    opener = urllib.request.build_opener(*([] if model.truthy(options.get("follow_redirects", True)) else [_Stay]))
    request = urllib.request.Request(args[0], body, headers, method=method.upper())
    began = time.monotonic()
    try:
        try:
            answer = opener.open(request, timeout=float(options.get("timeout", TIMEOUT_MS)) / 1000)
        except urllib.error.HTTPError as error:  # an answer like any other
            answer = error
        with answer:
            raw = answer.read(MAX_BODY + 1)
            if len(raw) > MAX_BODY:
                return Unknown(f"response_read_error: more than {MAX_BODY} bytes")
            found = {name: ", ".join(answer.headers.get_all(name)) for name in answer.headers.keys()}
            return {"status": float(answer.status), "body": raw.decode("utf-8", "replace"), "headers": found, "time": model.Time(_now()), "duration": float(int((time.monotonic() - began) * 1000))}
    except Exception as error:  # every failure is a value of the language
        return Unknown(_cause(error))


def _now():
    from evergrove.operators.log import utc_now

    return utc_now()


def _cause(error: Exception) -> str:
    reason = getattr(error, "reason", error)
    if isinstance(reason, socket.gaierror):
        return "dns_failure"
    if isinstance(reason, ConnectionRefusedError):
        return "connection_refused"
    if isinstance(reason, TimeoutError):
        return "timeout"
    return "tls_error" if isinstance(reason, ssl.SSLError) else f"network_error: {reason}"


#: Fixed values, with the reasons in `answer` and `_cause`.  Answers: status, the text if none is given, headers, and how many arguments follow the request.
ANSWERS = {
    "ok": (200, None, {}, (1, 1)),
    "ok_json": (200, None, {"Content-Type": "application/json"}, (1, 1)),
    "not_found": (404, "Not Found", {}, (0, 1)),
    "bad_request": (400, "Bad Request", {}, (0, 1)),
    "server_error": (500, "Internal Server Error", {}, (0, 1)),
    "redirect": (302, "Found", {}, (1, 1)),
}


def answer(name: str, args: list):
    """(path, record) to write as the response of the request in ``args[0]``."""
    status, text, headers, (least, most) = ANSWERS[name]
    if not least <= len(args) - 1 <= most:
        return Unknown(f"wrong number of arguments for {name}")
    request = args[0]
    if not isinstance(request, dict):
        return Unknown("request argument must be a Record")
    if "id" not in request:
        return Unknown("request record missing 'id' field")
    body = text if len(args) == 1 else args[1]
    if name == "redirect":
        body, headers = text, {"Location": args[1]}
    if name == "ok_json":
        body = model.to_json(body)
    if not isinstance(body, str) or not all(isinstance(v, str) for v in headers.values()):
        return Unknown(f"{name}() url must be Text" if name == "redirect" else "response body must be Text")
    return f"{REQUESTS}.{model.to_text(request['id'])}.response", {"status_code": float(status), "body": body, "headers": dict(headers)}

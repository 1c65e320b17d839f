"""JSON-RPC 2.0 over lines of text or HTTP, and the parsing of its params."""

from __future__ import annotations

import hmac
import json
import threading
from collections.abc import Callable, Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any, TextIO

from twinloom.api import FORBIDDEN, Agent, WriteForbidden
from twinloom.model import EARLIEST, LATEST

#: Codes of the protocol, words that end a session, and the largest HTTP body (fixed values).
PARSE_ERROR, INVALID_REQUEST, UNKNOWN_METHOD, INVALID_PARAMS, STORAGE_ERROR = -32700, -32600, -32601, -32602, -32000
GOODBYES = ("exit", "quit", "shutdown")
MAX_BODY = 16 << 20


class RpcError(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code, self.message = code, message


class Params:
    """Params by name, by position, or none."""

    def __init__(self, raw: Any) -> None:
        self.raw = raw

    def get(self, name: str, place: int) -> Any:
        if isinstance(self.raw, dict):
            return self.raw.get(name)
        if isinstance(self.raw, list) and place < len(self.raw):
            return self.raw[place]
        return None

    def text(self, name: str, place: int) -> str:
        value = self.get(name, place)
        if value is None and not (isinstance(self.raw, dict) and name in self.raw):
            raise RpcError(INVALID_PARAMS, "missing param")
        if not isinstance(value, str):
            raise RpcError(INVALID_PARAMS, "param must be a string")
        return value

    def text_or_none(self, name: str, place: int) -> str | None:
        return None if self.get(name, place) is None else self.text(name, place)

    def integer(self, name: str, place: int, default: int | None = None) -> int | None:
        """An integer or a text of one; other numbers and texts count as absent."""
        value = self.get(name, place)
        if value is None:
            return default
        if isinstance(value, bool) or not isinstance(value, (int, float, str)):
            raise RpcError(INVALID_PARAMS, "param must be an integer (or integer-valued string)")
        if isinstance(value, str):
            try:
                return int(value)
            except ValueError:
                return default
        return value if isinstance(value, int) else default

    def limit(self, place: int) -> int:
        value = self.integer("limit", place, 0)
        if value < 0:
            raise RpcError(INVALID_PARAMS, '"limit" must be >= 0 (0 = no cap)')
        return value


def _is_int(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def points_of(raw: Any) -> list[tuple[int, float]]:
    """[[t, v], ...] or [{ts or timestamp, value}, ...]; times are integers, values numbers, and there is at least one."""
    if raw is None:
        raise RpcError(INVALID_PARAMS, 'missing "points" array')
    if not isinstance(raw, list):
        raise RpcError(INVALID_PARAMS, '"points" must be an array of [ts, value] pairs')
    out = []
    for p in raw:
        if isinstance(p, list) and len(p) == 2:
            if not (_is_int(p[0]) and _is_number(p[1])):
                raise RpcError(INVALID_PARAMS, "points: ts must be an integer, value must be a number (pair form [ts, value])")
            out.append((p[0], float(p[1])))
        elif isinstance(p, dict):
            t = p["ts"] if "ts" in p else p.get("timestamp")
            if not (_is_int(t) and _is_number(p.get("value"))):
                raise RpcError(INVALID_PARAMS, 'points: object pairs need integer "ts" + number "value"')
            out.append((t, float(p["value"])))
        else:
            raise RpcError(INVALID_PARAMS, "points: expected a [ts, value] pair")
    if not out:
        raise RpcError(INVALID_PARAMS, '"points": must be a non-empty array of [timestamp, value] pairs')
    return out


def props_of(raw: Any) -> list[tuple[str, str | None]]:
    """An object or [[k, v], ...]; values that are no strings count as null."""
    if raw is None:
        return []
    if isinstance(raw, dict):
        pairs = list(raw.items())
    elif isinstance(raw, list):
        if any(not isinstance(p, list) or len(p) != 2 for p in raw):
            raise RpcError(INVALID_PARAMS, "props: array form must be [key, value] pairs")
        if any(not isinstance(p[0], str) for p in raw):
            raise RpcError(INVALID_PARAMS, "props: key must be a string")
        pairs = [(p[0], p[1]) for p in raw]
    else:
        raise RpcError(INVALID_PARAMS, "props: must be an object or an array of [k, v] pairs")
    return [(k, v if isinstance(v, str) else None) for k, v in pairs]


def relations_of(raw: Any) -> list[tuple[str, str, int | None]]:
    """[{to, relation_type, valid_from?}, ...] or [[to, relation_type], ...]."""
    if raw is None:
        return []
    if not isinstance(raw, list):
        raise RpcError(INVALID_PARAMS, "relations: must be an array of {to, relation_type} objects")
    out = []
    for r in raw:
        since = None
        if isinstance(r, dict):
            to, kind, since = r.get("to"), r.get("relation_type"), r.get("valid_from")
            if not isinstance(to, str):
                raise RpcError(INVALID_PARAMS, 'relations: every entry needs a string "to" (target entity name)')
            if not isinstance(kind, str):
                raise RpcError(INVALID_PARAMS, "relations: every entry needs a string \"relation_type\" ('topology:type')")
            if isinstance(since, str) and since.lstrip("+-").isdigit():
                since = int(since)
            if since is not None and not _is_int(since):
                raise RpcError(INVALID_PARAMS, 'relations: "valid_from" must be an integer')
        elif isinstance(r, list) and len(r) == 2:
            to, kind = r
            if not (isinstance(to, str) and isinstance(kind, str)):
                raise RpcError(INVALID_PARAMS, "relations: positional form is [to, relation_type]")
        else:
            raise RpcError(INVALID_PARAMS, "relations: entries must be objects {to, relation_type, valid_from?}")
        if ":" not in kind:
            raise RpcError(INVALID_PARAMS, "relations: \"relation_type\" must be 'topology:type' (e.g. 'electrical:feeds')")
        out.append((to, kind, since))
    return out


def _entity_key(p: Params) -> int:
    value = p.get("key", 0)
    if _is_int(value) and value >= 0:
        return value
    if isinstance(value, str):
        if value.isdigit():
            return int(value)
        raise RpcError(INVALID_PARAMS, f'"key" must be an unsigned integer, got "{value}"')
    raise RpcError(INVALID_PARAMS, '"key": missing param' if value is None else '"key": not a u32 integer')


def _window(p: Params, place: int, lo: int = 0) -> tuple[int, int]:
    return p.integer("from", place, lo), p.integer("to", place + 1, LATEST)


def _either(p: Params, names: tuple[str, str], place: int) -> str:
    return p.text(names[0] if p.get(names[0], place) is not None else names[1], place)


METHODS: dict[str, Callable[[Agent, Params], Any]] = {
    "schema": lambda a, p: a.schema(),
    "list_entities": lambda a, p: a.list_entities(p.text_or_none("type", 0), p.limit(1)),
    "graph": lambda a, p: a.graph(p.limit(0)),
    "query": lambda a, p: a.query(p.text("vql", 0)),
    "query_temporal": lambda a, p: a.query_temporal(p.text("vql", 0), p.integer("now", 1)),
    "get_entity": lambda a, p: a.get_entity(_entity_key(p)),
    "get_measurements": lambda a, p: a.get_measurements(p.text("entity", 0), p.text("signal", 1), *_window(p, 2)),
    "check": lambda a, p: a.check(p.text("entity", 0), p.text("signal", 1), *_window(p, 2)),
    "diagnose": lambda a, p: a.diagnose(p.text("entity", 0), *_window(p, 1)),
    "trace": lambda a, p: a.trace(_either(p, ("from", "from_name"), 0), _either(p, ("to", "to_name"), 1), p.integer("max_hops", 2, 6)),
    "provenance": lambda a, p: a.provenance(),
    "get_state": lambda a, p: a.get_state(p.text("entity", 0), p.text("key", 1), p.integer("at", 2)),
    "state_history": lambda a, p: a.state_history(p.text("entity", 0), p.text("key", 1)),
    "get_events": lambda a, p: a.get_events(p.text_or_none("entity", 0), *_window(p, 1, EARLIEST)),
    "audit": lambda a, p: a.audit(),
    "set_hypothesis": lambda a, p: a.set_hypothesis(p.text("entity", 0), p.text("text", 1)),
    "ingest_points": lambda a, p: a.ingest_points(p.text("entity", 0), p.text("signal", 1), points_of(p.get("points", 2))),
    "upsert_entity": lambda a, p: a.upsert_entity(p.text("name", 0), p.text("type", 1), props_of(p.get("props", 2)), relations_of(p.get("relations", 3)), p.text_or_none("source", 4) or "plc"),
    "set_state": lambda a, p: a.set_state(p.text("entity", 0), p.text("key", 1), p.text("value", 2), p.integer("at", 3)),
    "log_event": lambda a, p: a.log_event(p.text("name", 0), p.text("entity", 1), p.integer("timestamp", 2), p.integer("provenance", 3, 1), p.get("details", 4) if isinstance(p.get("details", 4), str) else ""),
    "retain": lambda a, p: a.retain(p.integer("before", 0)),
}
METHODS["entities"] = METHODS["list_entities"]


def _refusal(id_: Any, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}


def dispatch(agent: Agent, request: Any) -> dict | None:
    """The response to one request; None for a notification (a request without id)."""
    if not isinstance(request, dict):
        return _refusal(None, INVALID_REQUEST, "request must be a JSON object")
    id_, method = request.get("id"), request.get("method")
    if not isinstance(method, str):
        return _refusal(id_, INVALID_REQUEST, 'missing "method" string')
    try:
        if method not in METHODS:
            raise RpcError(UNKNOWN_METHOD, f'unknown method "{method}"')
        response = {"jsonrpc": "2.0", "id": id_, "result": METHODS[method](agent, Params(request.get("params")))}
    except RpcError as e:
        response = _refusal(id_, e.code, e.message)
    except WriteForbidden as e:
        response = _refusal(id_, FORBIDDEN, str(e))
    except Exception as e:  # the session goes on whatever a job fails of
        response = _refusal(id_, STORAGE_ERROR, str(e))
    return response if "id" in request else None


def serve(agent: Agent, lines: Iterable[str], out: TextIO) -> int:
    """Answers one request a line until the input ends or says goodbye; returns the number of requests."""
    served = 0
    for line in lines:
        line = line.strip()
        if not line:
            continue
        if line in GOODBYES:
            print(json.dumps({"jsonrpc": "2.0", "id": None, "result": {"bye": True}}), file=out, flush=True)
            break
        try:
            response = dispatch(agent, json.loads(line))
        except ValueError as e:
            response = _refusal(None, PARSE_ERROR, f"parse error: {e}")
        if response is not None:
            print(json.dumps(response), file=out, flush=True)
        served += 1
    return served


def http_server(agent: Agent, host: str = "127.0.0.1", port: int = 8888, token: str | None = None) -> ThreadingHTTPServer:
    """POST /rpc, GET /health and GET /schema; a token is asked of every request if one is set."""
    lock = threading.Lock()
    verbs = {"/rpc": "POST", "/health": "GET", "/schema": "GET"}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args: Any) -> None:
            pass

        def send(self, status: int, body: bytes | str | dict, kind: str = "text/plain") -> None:
            if isinstance(body, dict):
                body, kind = json.dumps(body), "application/json"
            body = body.encode() if isinstance(body, str) else body
            self.send_response(status)
            for k, v in (("Content-Type", kind), ("Content-Length", str(len(body))), ("Connection", "close"), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type, Authorization")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)
            self.close_connection = True

        def answer(self) -> None:
            if token is not None and not hmac.compare_digest(self.headers.get("Authorization", "").encode(), f"Bearer {token}".encode()):
                return self.send(401, "missing or invalid bearer token\n")
            length = self.headers.get("Content-Length", "0")
            if not length.isdigit():
                return self.send(400, "bad Content-Length\n")
            if int(length) > MAX_BODY:
                return self.send(413, "body exceeds 16 MiB limit\n")
            body = self.rfile.read(int(length))
            if self.command == "OPTIONS":
                return self.send(204, b"")
            if self.path not in verbs:
                return self.send(404, "not found (use POST /rpc or GET /health|/schema)\n")
            if self.command != verbs[self.path]:
                return self.send(405, f"use {verbs[self.path]} {self.path}\n")
            with lock:
                if self.path == "/health":
                    return self.send(200, f"ok {agent.agent_id} {agent.role.capitalize()}\n")
                if self.path == "/schema":
                    try:
                        return self.send(200, agent.schema())
                    except Exception as e:  # a failed job must not end the server
                        return self.send(500, {"error": str(e)})
                try:
                    request = json.loads(body.decode())
                except ValueError:
                    return self.send(400, _refusal(None, PARSE_ERROR, "parse error: body is not valid JSON"))
                response = dispatch(agent, request) or {"jsonrpc": "2.0", "id": None, "result": {"noted": True}}
            code = response.get("error", {}).get("code")
            return self.send(200 if code is None else 403 if code == FORBIDDEN else 400, response)

        do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = do_HEAD = do_OPTIONS = answer

    return ThreadingHTTPServer((host, port), Handler)

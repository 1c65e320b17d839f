"""A client of the RPC service: calls by name over HTTP, over a process's lines, or in this process.

A result of the form {"error": text} raises CallError with code 0, an RPC
error one with its own code. Parameters whose names are Python's own words are
given with an underscore behind them (``from_``).
"""

from __future__ import annotations

import itertools
import json
import subprocess
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Any

from twinloom.api import Agent
from twinloom.rpc import dispatch


class CallError(RuntimeError):
    """A refused or failed call."""

    def __init__(self, code: int, message: str) -> None:
        super().__init__(f"{message} ({code})")
        self.code, self.message = code, message


class Client:
    """Calls any method by name: ``client.call("check", entity="M", signal="x")`` or ``client.check("M", "x")``."""

    def __init__(self, send: Callable[[dict], dict]) -> None:
        """send: from a request to its response."""
        self._send, self._ids = send, itertools.count(1)

    @classmethod
    def of(cls, agent: Agent) -> Client:
        return cls(lambda request: json.loads(json.dumps(dispatch(agent, request))))

    @classmethod
    def over_http(cls, url: str, token: str | None = None, timeout: float = 600.0) -> Client:
        def send(request: dict) -> dict:
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
            try:
                with urllib.request.urlopen(urllib.request.Request(url, json.dumps(request).encode(), headers), timeout=timeout) as answer:  # noqa: S310
                    return json.load(answer)
            except urllib.error.HTTPError as e:  # refusals have a body too
                return json.load(e) if "json" in e.headers.get("Content-Type", "") else {"error": {"code": e.code, "message": e.read().decode().strip()}}

        return cls(send)

    @classmethod
    def over_lines(cls, process: subprocess.Popen) -> Client:
        """process: a service with text pipes, as ``python -m twinloom --db DIR --service`` is."""
        def send(request: dict) -> dict:
            process.stdin.write(json.dumps(request) + "\n")
            process.stdin.flush()
            return json.loads(process.stdout.readline())

        return cls(send)

    def call(self, method: str, *args: Any, **named: Any) -> Any:
        params: Any = list(args) if args else {k.removesuffix("_"): v for k, v in named.items() if v is not None}
        if args and named:
            raise TypeError("either places or names")
        answer = self._send({"jsonrpc": "2.0", "id": next(self._ids), "method": method, "params": params})
        if answer.get("error") is not None:
            raise CallError(answer["error"]["code"], answer["error"]["message"])
        result = answer.get("result")
        if isinstance(result, dict) and set(result) == {"error"}:
            raise CallError(0, result["error"])
        return result

    def __getattr__(self, method: str) -> Callable:
        if method.startswith("_"):
            raise AttributeError(method)
        return lambda *args, **named: self.call(method, *args, **named)

"""Readings from message flows and field gateways: payloads to ingest calls, results to messages."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from twinloom.api import Agent
from twinloom.rpc import points_of

#: Registers hold tenths (fixed value).
SCALE = 10.0


def ingest_call(payload: Any, entity: str | None = None, signal: str | None = None) -> tuple[str, str, list[tuple[int, float]]]:
    """(entity, signal, points) of {entity, signal, points} or of a bare [t, value]; names that it lacks come from the defaults."""
    named = payload if isinstance(payload, dict) else {}
    entity, signal = named.get("entity") or entity, named.get("signal") or signal
    points = named.get("points")
    if isinstance(payload, list) and len(payload) == 2 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in payload):
        points = [payload]
    if not entity or not signal or not isinstance(points, list) or not points:
        raise ValueError("a payload must be {entity, signal, points: [[ts, value], ...]} with at least one point")
    return entity, signal, points_of(points)


def violations(result: dict) -> list[dict]:
    """The check's result in a list if it is a violation, else none."""
    return [result] if result.get("status") == "VIOLATION" else []


def gateway_reading(agent: Agent, registers: Sequence[int], entity: str, signal: str, at: int, type: str = "Motor") -> dict:
    """Takes two holding registers, a value and its upper bound in tenths, into the twin, and checks the hour from then on.

    The bound is shown without a point if it is whole, as bounds are stored.
    """
    value, bound = (r / SCALE for r in registers[:2])
    agent.upsert_entity(entity, type, [(f"spec.{signal}.max", f"{bound:g}")], source="plc")
    agent.ingest_points(entity, signal, [(at, value)])
    return agent.check(entity, signal, at, at + 3600)

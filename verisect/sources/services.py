"""Callers of remote tools, outside the query engine: replies are landed as files and scanned from there.

A transport is any function (url, headers, body) -> (content type, text); tests pass their own, so nothing here needs a network.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field


class ToolError(RuntimeError):
    """A tool's or the protocol's error."""


def http(url: str, headers: dict, body: bytes, timeout: float = 120) -> tuple[str, str]:
    request = urllib.request.Request(url, data=body, headers=headers)
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return reply.headers.get("Content-Type", ""), reply.read().decode("utf-8")


def events(text: str) -> Iterator[dict]:
    """The JSON messages of a server-sent event stream."""
    for block in text.replace("\r\n", "\n").split("\n\n"):
        data = "\n".join(line[5:].lstrip() for line in block.split("\n") if line.startswith("data:"))
        if data:
            yield json.loads(data)


@dataclass
class ToolClient:
    """JSON-RPC over HTTP with retries, a bound on calls in flight, and a minimum gap between them."""

    url: str
    token: str | None = None
    transport: Callable[[str, dict, bytes], tuple[str, str]] = http
    tries: int = 4
    wait: float = 1.0
    gap: float = 0.0
    permits: int = 4
    _last: float = field(default=0.0, repr=False)
    _id: int = field(default=0, repr=False)

    def __post_init__(self):
        self._free, self._lock = threading.Semaphore(self.permits), threading.Lock()

    def request(self, method: str, params: dict | None = None) -> dict:
        with self._lock:
            self._id += 1
            message = {"jsonrpc": "2.0", "id": self._id, "method": method, "params": params or {}}
            pause = self._last + self.gap - time.monotonic()
            if pause > 0:
                time.sleep(pause)
            self._last = time.monotonic()
        headers = {"Content-Type": "application/json", "Accept": "application/json, text/event-stream"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        error: Exception | None = None
        for attempt in range(self.tries):
            try:
                with self._free:
                    kind, text = self.transport(self.url, headers, json.dumps(message).encode())
                replies = list(events(text)) if "event-stream" in kind else [json.loads(text)]
                reply = next(r for r in replies if r.get("id") == message["id"])
                if "error" in reply:
                    raise ToolError(str(reply["error"]))
                return reply["result"]
            except (OSError, ValueError, StopIteration) as e:
                error = e
                time.sleep(self.wait * 2**attempt)
        raise ToolError(f"{method} failed {self.tries} times: {error}")

    def tools(self) -> list[dict]:
        """All tools, page after page."""
        found, cursor = [], None
        while True:
            page = self.request("tools/list", {"cursor": cursor} if cursor else {})
            found += page.get("tools", [])
            cursor = page.get("nextCursor")
            if not cursor:
                return found

    def call(self, name: str, arguments: dict) -> tuple[str, bool, dict | None]:
        """Text, whether it is an error, and the structured content."""
        reply = self.request("tools/call", {"name": name, "arguments": arguments})
        text = "\n".join(c.get("text", "") for c in reply.get("content", []) if c.get("type") == "text")
        return text, bool(reply.get("isError")), reply.get("structuredContent")


class MockProvider:
    """A model that answers the same question the same way: for runs without a network."""

    def __init__(self, rounds: int = 0):
        self.rounds = rounds

    def start(self, question: dict) -> dict:
        return {"question": question, "turn": 0, "messages": [question["prompt"]]}

    def step(self, state: dict, tools: list[str]) -> dict:
        state["turn"] += 1
        if tools and state["turn"] <= self.rounds:
            return {"calls": [{"name": tools[0], "arguments": {"q": state["question"]["id"]}}], "text": None}
        return {"calls": [], "text": f"Answer to {state['question']['id']} after {len(state['messages'])} messages."}

    def add_results(self, state: dict, results: list[str]) -> None:
        state["messages"] += results


def run_question(provider, question: dict, call: Callable[[str, dict], str], tools: list[str], most: int = 8, leaked: Callable[[str], bool] = lambda text: False) -> dict:
    """One question's bounded tool loop: the last turn has no tools, and a tool call written as text gets one more turn."""
    state, log = provider.start(question), []
    for turn in range(most + 2):
        reply = provider.step(state, tools if turn < most else [])
        if not reply["calls"]:
            if leaked(reply["text"] or "") and turn <= most:
                provider.add_results(state, ["Tools are closed. Write your final answer as plain text."])
                tools = []
                continue
            return {"qid": question["id"], "raw_answer": reply["text"], "tool_calls": log, "error": None}
        results = []
        for c in reply["calls"]:
            try:
                text, failed = call(c["name"], c["arguments"]), False
            except ToolError as e:
                text, failed = str(e), True
            log.append({"turn": turn, "name": c["name"], "args": c["arguments"], "is_error": failed, "result_chars": len(text)})
            results.append(text)
        provider.add_results(state, results)
    return {"qid": question["id"], "raw_answer": None, "tool_calls": log, "error": "no answer within the turns"}


def within_context(messages: list[str], limit: int, letters_per_token: float = 4.0) -> bool:
    """Whether a conversation still fits a model's context, by a rough count of its tokens."""
    return sum(map(len, messages)) / letters_per_token <= limit


def wait_for_quiet(busy: Callable[[], bool], pause: float = 5.0, most: float = 600.0) -> bool:
    """Yields a shared machine to others: waits until it isn't busy; false if it stays busy."""
    until = time.monotonic() + most
    while busy():
        if time.monotonic() >= until:
            return False
        time.sleep(pause)
    return True

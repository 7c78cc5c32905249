"""A client of chat-completion services, as an Extractor and a Generator.

The key comes from an environment variable of the worker, never from Spark's settings. Temperature 0 makes tables
reproducible as far as the service allows.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from dataclasses import dataclass
from functools import partial

from quire.functions.prompts import EXTRACTION, fill
from quire.settings import Settings


#: Replies of a service that a later try may better, and the first pause before one, which doubles.
BUSY = {408, 409, 425, 429, 500, 502, 503, 504}
PAUSE = 0.5


@dataclass
class ChatClient:
    base_url: str
    model: str
    key_variable: str
    temperature: float = 0.0
    max_tokens: int = 4096
    timeout: float = 120.0
    attempts: int = 3

    def _ask(self, prompt: str, **more: object) -> str:
        key = os.environ.get(self.key_variable)
        if not key:
            raise RuntimeError(f"{self.key_variable} is not set")
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.max_tokens, **more}
        request = urllib.request.Request(self.base_url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        for left in reversed(range(max(1, self.attempts))):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return json.load(reply)["choices"][0]["message"]["content"]
            except urllib.error.URLError as e:
                if not left or getattr(e, "code", 503) not in BUSY:
                    raise
            time.sleep(PAUSE * 2 ** (self.attempts - 1 - left))
        raise AssertionError("unreachable")

    def generate(self, prompt: str) -> str:
        return self._ask(prompt)

    def extract(self, text: str, title: str) -> str:
        return self._ask(fill(EXTRACTION, title=title, text=text), response_format={"type": "json_object"})


def chat_factory(base_url: str, model: str, key_variable: str, temperature: float = 0.0, max_tokens: int = 4096, timeout: float = 120.0, attempts: int = 3) -> partial:
    """A factory that workers call; it carries the options and no secret."""
    return partial(ChatClient, base_url, model, key_variable, temperature, max_tokens, timeout, attempts)


def chat_of(settings: Settings, stage: str) -> partial | None:
    """The factory of a stage (extraction, compression, generation, demo) by its settings; None if no service is set."""
    chat, own = settings.section("chat"), settings.section(stage)
    if not chat["base_url"]:
        return None
    return chat_factory(chat["base_url"], chat["model"], chat["key_variable"], own["temperature"], own["max_tokens"], chat["timeout"], chat["attempts"])

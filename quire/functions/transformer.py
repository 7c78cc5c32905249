"""Local transformer models in ONNX form, as an Embedder and a Reranker.

A model is a folder with ``model.onnx`` and ``tokenizer.json``; the folder must be reachable from the workers. Sequences are
cut at ``max_length`` tokens. Both packages are imported where a model is loaded, so that nothing else needs them.
"""

from __future__ import annotations

from functools import partial
from pathlib import Path

import numpy as np

from quire.functions.models import last_token_pool
from quire.settings import Settings


class _Session:
    def __init__(self, folder: str, max_length: int, providers: list[str] | None, left: bool) -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(str(Path(folder) / "tokenizer.json"))
        self.tokenizer.enable_truncation(max_length)
        self.tokenizer.enable_padding(direction="left" if left else "right")
        self.session = onnxruntime.InferenceSession(str(Path(folder) / "model.onnx"), providers=providers or onnxruntime.get_available_providers())
        self.inputs = {x.name for x in self.session.get_inputs()}

    def run(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """First output and mask of a batch of texts or pairs of texts."""
        made = self.tokenizer.encode_batch(texts)
        mask = np.array([x.attention_mask for x in made], dtype=np.int64)
        given = {"input_ids": np.array([x.ids for x in made], dtype=np.int64), "attention_mask": mask, "token_type_ids": np.array([x.type_ids for x in made], dtype=np.int64)}
        return self.session.run(None, {k: v for k, v in given.items() if k in self.inputs})[0], mask


class TransformerEmbedder:
    """The state of the last token as a text's vector; a query has the instruction before it."""

    def __init__(self, folder: str, max_length: int = 2048, instruction: str = "", providers: list[str] | None = None) -> None:
        self.model, self.instruction = _Session(folder, max_length, providers, left=True), instruction

    def embed(self, texts: list[str], is_query: bool) -> np.ndarray:
        states, mask = self.model.run([(self.instruction if is_query else "") + t for t in texts])
        return last_token_pool(states, mask).astype(np.float32)


class TransformerReranker:
    """One score for a pair of query and text, the first column of the model's logits."""

    def __init__(self, folder: str, max_length: int = 512, providers: list[str] | None = None) -> None:
        self.model = _Session(folder, max_length, providers, left=False)

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        logits, _ = self.model.run(pairs)
        return np.asarray(logits, dtype=np.float64).reshape(len(pairs), -1)[:, 0].tolist()


def embedder_of(settings: Settings) -> partial | None:
    """The embedder of the settings, None if they name no model."""
    own = settings.section("embedding")
    return partial(TransformerEmbedder, own["model"], own["max_length"], own.get("instruction", "")) if own.get("model") else None


def reranker_of(settings: Settings) -> partial | None:
    own = settings.section("rerank")
    return partial(TransformerReranker, own["model"], own["max_length"]) if own.get("model") else None

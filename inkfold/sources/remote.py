"""Chat services as generators. The address, model and key come from the environment of the workers."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable

from ..operators.answer import Generator, register_generator

PROMPT = (
    "Answer the question from the numbered sources only. Name the sources you use in square brackets by their id. "
    "If they don't hold the answer, reply with NO_ANSWER.\n\nSources:\n{sources}\n\nQuestion: {question}"
)


def retried(call: Callable[[], str], tries: int = 3, wait: float = 1.0) -> str:
    """``call``, up to ``tries`` times with waits of 1, 2, ... times ``wait``; the last error is raised."""
    for i in range(tries):
        try:
            return call()
        except Exception:
            if i == tries - 1:
                raise
            time.sleep(wait * (i + 1))
    raise AssertionError("tries must be positive")


def chat(prompt: str, temperature: float = 0.5, max_tokens: int = 500, wait: float = 1.0) -> str:
    """One completion from a service with the usual chat interface: LLM_BASE_URL, LLM_MODEL, LLM_API_KEY."""
    url = os.environ["LLM_BASE_URL"].rstrip("/") + "/chat/completions"
    body = {"model": os.environ.get("LLM_MODEL", "default"), "messages": [{"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": max_tokens}
    head = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get('LLM_API_KEY', '')}"}

    def call() -> str:
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=60) as r:
            return json.load(r)["choices"][0]["message"]["content"]

    return retried(call, wait=wait)


def chat_generator() -> Generator:
    def answer(questions: list[str], citations: list[list[dict]]) -> list[str]:
        out = []
        for q, cs in zip(questions, citations):
            sources = "\n".join(f"[{c['source_id']}] {c['snippet']}" for c in cs)
            out.append(chat(PROMPT.format(sources=sources, question=q)) if cs else "")
        return out

    return answer


def vision_generator(model: str = "Qwen/Qwen2.5-VL-3B-Instruct", max_tokens: int = 512) -> Generator:
    """A local vision-language model, loaded once in each worker that has the libraries and the weights."""
    from transformers import AutoModelForImageTextToText, AutoProcessor

    net, prepare = AutoModelForImageTextToText.from_pretrained(model, dtype="auto", device_map="auto"), AutoProcessor.from_pretrained(model)

    def complete(question: str, sources: list[dict]) -> str:
        asked = PROMPT.format(sources="\n\n".join(f"[{c['source_id']}] {c['snippet']}" for c in sources), question=question)
        text = prepare.apply_chat_template([{"role": "user", "content": asked}], tokenize=False, add_generation_prompt=True)
        given = prepare(text=[text], return_tensors="pt").to(net.device)
        made = net.generate(**given, max_new_tokens=max_tokens)[:, given["input_ids"].shape[1] :]
        return prepare.batch_decode(made, skip_special_tokens=True)[0].strip()

    return lambda questions, citations: [complete(q, cs) if cs else "" for q, cs in zip(questions, citations)]


register_generator("chat", chat_generator)
register_generator("qwen-vision", vision_generator)
register_generator("deepseek", chat_generator)

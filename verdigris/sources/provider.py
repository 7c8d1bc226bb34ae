"""Models behind litellm, where that package is installed on the executors."""

from __future__ import annotations


def completion(messages: list[dict], options: dict) -> dict:
    """One call: its text and the tokens that it was billed for."""
    import litellm

    reply = litellm.completion(messages=messages, **options)
    usage = getattr(reply, "usage", None)
    return {"text": reply.choices[0].message.content, "usage": {name: getattr(usage, name, 0) for name in ("prompt_tokens", "completion_tokens")}}

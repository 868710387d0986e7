"""Signs that a text speaks to an assistant and not to its reader."""

from __future__ import annotations

import re

#: Phrases and shapes of instructions aimed at an assistant.
OVERRIDE = re.compile(
    r"\b(?:ignore|disregard|forget|override|bypass)\s+(?:all\s+|any\s+|every\s+)?(?:of\s+)?(?:the\s+|your\s+|these\s+|those\s+|my\s+)?(?:previous|prior|above|earlier|preceding|foregoing|original|initial|system|prior\s+system)\s+(?:instruction|prompt|rule|direction|guideline|message|context)s?\b",
    re.IGNORECASE | re.ASCII,
)
ROLE = re.compile(
    r"(?:(?:^|[\n\r])[ \t>*#-]*system\s*(?:prompt|message)\s*:)|\b(?:you\s+are\s+now|from\s+now\s+on,?\s+you|new\s+instructions?:|(?:act\s+as|pretend\s+(?:that\s+)?(?:you\s+are|you're|to\s+be))\s+(?:a\s+|an\s+|the\s+)?(?:unrestricted|unfiltered|uncensored|jailbroken|different\s+(?:AI|assistant|model)|DAN\b|developer\s+mode|root|admin(?:istrator)?|god\s+mode)|pretend\s+(?:that\s+)?you\s+(?:have\s+no|do\s+not\s+have|don't\s+have)\s)",
    re.IGNORECASE | re.ASCII,
)
EXFILTRATION = re.compile(
    r"\b(?:send|post|forward|upload|transmit|exfiltrate|email)\s+(?:the\s+|all\s+|your\s+|this\s+|any\s+|our\s+){0,2}(?:conversation(?:\s+history)?|chat\s+(?:history|log)|message\s+history|transcript|system\s+prompt|credentials?|api\s+keys?|tokens?|secrets?)\s+(?:to|at|via|using|through)\s+(?:https?://|www\.|[\w.+-]+@[\w-]+\.[a-z]{2,}|(?:this|the\s+following|my)\s+(?:url|link|endpoint|address|webhook)\b|[\w-]+\.(?:com|net|org|io|co|dev|app|xyz|top|site|info|ru|cn|me|sh|link)\b)",
    re.IGNORECASE | re.ASCII,
)
TOOL = re.compile(r"\b(?:call|invoke|execute|run)\s+(?:the\s+)?(?:tool|function|command|shell|bash)\b.{0,40}\b(?:curl|wget|fetch|http|eval|exec)\b", re.IGNORECASE | re.ASCII)
IMAGE = re.compile(r"!\[[^\]]*\]\(\s*https?://[^)\s]*\{[^}]*\}[^)]*\)")
HIDDEN_CSS = re.compile(r"<[^<>]+style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|opacity\s*:\s*0|color\s*:\s*(?:#fff(?:fff)?|white|transparent))[^\"']*[\"']", re.IGNORECASE)
COMMENT = re.compile(r"<!--[\s\S]{0,4000}?-->")
#: Characters without a width (joiners of scripts and emoji are not among them), tags, overrides of direction, and
#: scripts written without spaces, where U+200B parts words.
ZERO_WIDTH = re.compile("[\u200b\u2060\ufeff\u180e]")
TAGS, DIRECTION = re.compile("[\U000e0000-\U000e007f]"), re.compile("[\u202d\u202e]")
UNSPACED = re.compile("[\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u1a20-\u1aaf\ua980-\ua9df\u1b00-\u1b7f]")

#: Signal: weight, and words of which a text must have one (lower case) to be searched.
WEIGHTS = {"override": 3, "role": 3, "exfil": 3, "tool": 3, "image-exfil": 3, "hidden-css": 2, "comment": 2, "invisible": 3}
LEAST_WEIGHT, LEAST_LENGTH = 3, 24


def _has(low: str, *words: str) -> bool:
    return any(w in low for w in words)


def _invisible(text: str) -> bool:
    if text.isascii():
        return False
    if TAGS.search(text) or DIRECTION.search(text):
        return True
    odd = [m.start() for m in ZERO_WIDTH.finditer(text)]
    if len(odd) < 8:
        return False
    n = sum(not (text[k] == "\u200b" and UNSPACED.search(text, max(0, k - 2), k + 3)) for k in odd)
    return n >= 8 and n / len(text) > 0.0008


def signals(text: str, low: str | None = None) -> list[str]:
    """Names of the signals that the text gives, in the order of ``WEIGHTS``."""
    low = text.lower() if low is None else low
    override = _has(low, "ignore", "disregard", "forget", "override", "bypass") and OVERRIDE.search(text)
    role = _has(low, "system", "you are now", "from now", "new instruction", "act", "pretend", "you\tare", "you\nare", "from\nnow") and ROLE.search(text)
    fired = {
        "override": override,
        "role": role,
        "exfil": _has(low, "send", "post", "forward", "upload", "transmit", "exfiltrate", "email") and EXFILTRATION.search(text),
        "tool": _has(low, "tool", "function", "command", "shell", "bash") and TOOL.search(text),
        "image-exfil": "![" in text and IMAGE.search(text),
        "hidden-css": "style" in low and HIDDEN_CSS.search(text),
        "comment": (override or role) and "<!--" in text and COMMENT.search(text),
        "invisible": _invisible(text),
    }
    return [name for name in WEIGHTS if fired[name]]


def injection(text: str, low: str | None = None) -> list[str]:
    """The signals, if together they weigh enough."""
    found = signals(text, low) if len(text) >= LEAST_LENGTH else []
    return found if sum(WEIGHTS[s] for s in found) >= LEAST_WEIGHT else []


def visible(text: str) -> str:
    """The text without its invisible characters."""
    return DIRECTION.sub("", TAGS.sub("", ZERO_WIDTH.sub("", text)))

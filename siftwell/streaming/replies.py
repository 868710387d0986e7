"""Replies that grow while they are read: each new stretch of a conversation's text is scanned once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftwell import prepare
from siftwell.functions import checks
from siftwell.operators.policy import Policy
from siftwell.operators.rule import Rule
from siftwell.operators.scanner import Scanner

#: Characters of a window and of its overlap with what was read before; text too short to read; events remembered; context of an event.
WINDOW, OVERLAP, LEAST, REMEMBERED, AROUND = 6000, 1000, 40, 64, 30


def for_replies(rule: Rule) -> bool:
    """Whether a rule's finding is worth an alert about text that its reader did not write."""
    if rule.synthetic or rule.advisory or rule.severity not in ("critical", "high"):
        return False
    return rule.severity == "critical" or (rule.category not in ("generic", "prose") and rule.confidence != "possible")


def reply_policy(policy: Policy | None = None) -> Policy:
    policy = policy or Policy()
    return replace(policy, rules=tuple(r for r in policy.rules if for_replies(r)), prose=False, tables=False, injection=False)


@dataclass
class Mark:
    """How far a conversation has been read: -1 before its first text; what was before that text's end is unread history."""

    read: int = -1
    unread: int = 0
    seen: list[str] = field(default_factory=list)


def windows(mark: Mark, body: str) -> Iterator[str]:
    """The stretches that are new, moving the mark.

    The first text is read from its last window on.  A text that has become a little shorter is anchored anew at its end; one that lost
    more than half is another conversation, of which nothing is remembered and whose next text is its first.
    """
    if len(body) < LEAST:
        return
    if mark.read < 0:
        mark.read = mark.unread = max(0, len(body) - WINDOW)
    elif len(body) < mark.read / 2:
        mark.read, mark.unread, mark.seen = -1, 0, []
        return
    elif len(body) < mark.read:
        mark.read = max(0, len(body) - WINDOW)
    while mark.read < len(body):
        begin = max(0, mark.read - OVERLAP)
        end = min(len(body), begin + WINDOW)
        yield body[begin:end]
        mark.read = end


def alerts(scanner: Scanner, mark: Mark, body: str) -> Iterator[list]:
    """The findings of each new stretch, unless the same values in the same surroundings have been told of before."""
    for chunk in windows(mark, body):
        found = [f for f in scanner.scan(chunk).findings if not f.rule.advisory]
        if not found:
            continue
        around = lambda f: re.sub(r"\s+", " ", chunk[max(0, f.start - AROUND) : f.end + AROUND]).strip()  # noqa: B023, E731
        key = checks.fingerprint("|".join(sorted(f"{checks.fingerprint(f.value or f.match, scanner.policy.salt)}@{around(f)}" for f in found)))
        if key not in mark.seen:
            mark.seen = [*mark.seen, key][-REMEMBERED:]
            yield found


STATE = "read long, unread long, seen array<string>"
ALERT = "conv_id long, seq long, rules string, severity string, previews string, unread long"


def watch_replies(texts: DataFrame, policy: Policy | None = None, late: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """Alerts of a stream of (conv_id long, seq long, ts timestamp, text): a conversation's visible text at one time after another.

    State per conversation is two marks and 64 digests, never its text; it goes when event time, less ``late``, is ``idle`` past the
    conversation's last text.  Rows of a trigger are read in the order of ``seq``.
    """
    chosen = reply_policy(policy)
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        scanner, out, last = Scanner(chosen), [], state.getCurrentWatermarkMs()
        old = state.get if state.exists else None
        mark = Mark(int(old[0]), int(old[1]), list(old[2])) if old else Mark()
        for row in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
            for found in alerts(scanner, mark, row.text or ""):
                grave = "critical" if any(f.severity == "critical" for f in found) else "high"
                names = ",".join(dict.fromkeys(f.rule.id for f in found))
                out.append((key[0], row.seq, names, grave, ", ".join(checks.mask(f.value or f.match) for f in found), mark.unread))
            last = max(last, row.ms)
        state.update((mark.read, mark.unread, mark.seen))
        state.setTimeoutTimestamp(last + milliseconds)
        yield pd.DataFrame(out, columns=["conv_id", "seq", "rules", "severity", "previews", "unread"])

    prepare(texts.sparkSession)
    timed = texts.select("conv_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "text").withWatermark("ts", late)
    timed = timed.withColumn("ms", F.coalesce(F.unix_millis("ts"), F.lit(0)))
    return timed.groupBy("conv_id").applyInPandasWithState(run, ALERT, STATE, "append", GroupStateTimeout.EventTimeTimeout)

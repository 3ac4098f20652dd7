r"""Chat formatting with a grammar that round-trips.

    conversation = { turn }
    turn         = "### " Role ": " body "</turn>" LF
    body         = { character | "\" escape }

A run of backslashes before a control string ("### " or "</turn>") is twice as long
in the body as in the text, and one longer still if the control string belongs to
the text.  So an even run before "</turn>" ends the turn, an odd one does not, and
no other backslash changes.  Role is the role with its first letter raised; other
roles, and those that would not come back, are written as JSON strings.

Each turn is rendered plainly first.  The parser reads the result; while the turns
it recovers differ from the source, what conflicts is escaped and read again.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>"
_CONTROL = re.compile(r"(\\*)(### |</turn>)")
_TAIL = re.compile(r"(\\+)\Z")
_ROLE = re.compile(r"### ([A-Z][a-z_]*|\"(?:[^\"\\]|\\.)*\"): ")


class Parser:
    """Deterministic and incremental: feed() takes text, turns come out as they end."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str, int, int]]:
        """(role, text, start and end of the body in rest + text) of each turn that ends."""
        s, at = self.rest + text, 0
        while at < len(s):
            head = _ROLE.match(s, at)
            if not head:
                if s.startswith(HEAD, at) and END not in s[at:]:
                    break
                raise ValueError("a turn must begin with its role")
            for m in _CONTROL.finditer(s, head.end()):
                if m[2] == END and len(m[1]) % 2 == 0:
                    break
                if m[2] == HEAD and len(m[1]) % 2 == 0:
                    raise ValueError("a turn begins inside a turn")
            else:
                break
            body = m.start() + len(m[1])
            yield read_role(head[1]), unescape(s[head.end() : body]), head.end(), body
            at = m.end()
            if s.startswith("\n", at):
                at += 1
            elif at < len(s):
                raise ValueError("a line feed must follow a turn")
        self.rest = s[at:]


def show_role(role: str) -> str:
    return role[0].upper() + role[1:] if re.fullmatch("[a-z][a-z_]*", role) else json.dumps(role)


def read_role(shown: str) -> str:
    return json.loads(shown) if shown[0] == '"' else shown[0].lower() + shown[1:]


def escape(text: str) -> str:
    return _TAIL.sub(lambda m: m[1] * 2, _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text))


def unescape(body: str) -> str:
    return _TAIL.sub(lambda m: m[1][len(m[1]) // 2 :], _CONTROL.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], body))


def recovered(formatted: str) -> list[tuple[str, str]] | None:
    """The turns in formatted; None if it is not in the language."""
    parser = Parser()
    try:
        found = [(role, text) for role, text, _, _ in parser.feed(formatted)]
    except ValueError:
        return None
    return None if parser.rest else found


def render(role: str, text: str) -> str:
    """One turn, escaped only if it would not come back otherwise."""
    for body in (text, escape(text)):
        formatted = f"{HEAD}{show_role(role)}: {body}{END}\n"
        if recovered(formatted) == [(role, text)]:
            return formatted
    raise ValueError(f"a turn of {role!r} does not come back")


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds ``formatted`` to conv_id, turn, role and text; no rows move.

    Formatted turns, put together by conv_id in the order of turn, role and text, are
    the conversation.  Null role or text: empty.  Empty role: the role "".
    """

    def run(role: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([render(r, t) for r, t in zip(role, text, strict=True)], dtype=object)

    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.withColumn("formatted", F.pandas_udf(run, "string")("role", "text"))


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, mask_chars long"


class Summary:
    """What the formatted text of one conversation says, read turn by turn in bounded memory."""

    def __init__(self, conv_id: int | None, trained: str):
        self.conv_id, self.trained, self.parser = conv_id, trained, Parser()
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.mask = 0

    def feed(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text, start, end in self.parser.feed(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == self.trained:
                self.loss.update(text.encode())
                self.loss_chars += len(text)
                self.mask += end - start

    def row(self) -> tuple:
        if self.parser.rest:
            raise ValueError("the conversation ends inside a turn")
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.mask


def read_back(formatted: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation (SUMMARY) from formatted turns.

    The loss mask covers the bodies of turns by ``trained``; mask_chars counts it as
    formatted, loss_chars as the texts come back.  A null conv_id is one
    conversation.  An empty table gives no rows.  A conversation streams through one
    task in its order, as its digest requires, but is never held there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Summary | None = None
        for pdf in batches:
            done = []
            for null, conv_id, text in zip(pdf["conv_id"].isna(), pdf["conv_id"], pdf["formatted"], strict=True):
                key = None if null else int(conv_id)
                if now is None or now.conv_id != key:
                    done += [now.row()] if now else []
                    now = Summary(key, trained)
                now.feed(text)
            if done:
                yield _frame(done)
        if now:
            yield _frame([now.row()])

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in SUMMARY.split(", ")])
        return out.assign(conv_id=out["conv_id"].astype("Int64"))

    order = ["conv_id", "turn", "role", "text"]
    return formatted.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "formatted").mapInPandas(run, SUMMARY)


#: DuckDB SQL of read_back(format_turns()) over the table conversations and conversation -7, for roles of small letters.
SQL = r"""
with said as (select '\### Assistant: </turn> ok' as text),
turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', text from said union all select -7, 1, 'assistant', text from said),
escaped as (select *, regexp_replace(regexp_replace(text, '(\\*)(### |</turn>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1') as body from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('### ' || role || ': ' || body || '</turn>') + 1) as bigint) as formatted_chars,
  cast(coalesce(sum(length(body)) filter (role = 'assistant'), 0) as bigint) as mask_chars
from escaped group by conv_id
"""

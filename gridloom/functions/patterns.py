"""Date patterns of two kinds, as Columns: letters after ``%``, and runs of letters.

A pattern becomes tokens, a letter and how often it stands, or text. The session's own formatter does what it can in
one go; the week-based parts, which it doesn't have, and centuries are worked out beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters after % as runs of letters, and those that are not known.
PERCENT = {
    "a": "EEE", "b": "MMM", "c": "M", "d": "dd", "e": "d", "f": "SSSSSS", "H": "HH", "h": "hh", "I": "hh", "i": "mm", "j": "DDD", "k": "H", "l": "h", "M": "MMMM", "m": "MM", "p": "a",
    "r": "hh:mm:ss a", "S": "ss", "s": "ss", "T": "HH:mm:ss", "v": "ww", "W": "EEEE", "x": "xxxx", "Y": "yyyy", "y": "yy",
}
UNKNOWN_PERCENT = "DUuVwX"
#: Letters of runs.
LETTERS = "GCYxweEyDMdaKhHkmsSzZ"
#: Letters that the session's formatter lacks or reads otherwise.
OWN = "CxweZz"
WEEK = "xwe"
Token = tuple[str, int | str]  # letter and times, or "" and text


def runs(pattern: str) -> list[Token]:
    """Tokens of a pattern of runs of letters; text stands in quotes, a quote is doubled."""
    if not pattern:
        raise ValueError("an empty pattern")
    found: list[Token] = []
    at = 0
    while at < len(pattern):
        if pattern.startswith("''", at):
            found.append(("", "'"))
            at += 2
        elif pattern[at] == "'":
            end, text = at + 1, ""
            while end < len(pattern) and (pattern[end] != "'" or pattern.startswith("''", end)):
                text += pattern[end]
                end += 2 if pattern[end] == "'" else 1
            if end >= len(pattern):
                raise ValueError("a quote without its end")
            found.append(("", text))
            at = end + 1
        else:
            letter, same = next((k, len(list(g))) for k, g in groupby(pattern[at:]))
            if letter.isascii() and letter.isalpha():
                if letter not in LETTERS:
                    raise ValueError(f"{letter} is not supported")
                found.append((letter, same))
            else:
                found.append(("", letter * same))
            at += same
    return found


def percents(pattern: str) -> list[Token]:
    """Tokens of a pattern of letters after %; another character after % stands for itself."""
    found: list[Token] = []
    rest = iter(pattern)
    for x in rest:
        letter = next(rest, None) if x == "%" else None
        if x != "%":
            found.append(("", x))
        elif letter in PERCENT:
            found += runs(PERCENT[letter])
        elif letter is not None and letter in UNKNOWN_PERCENT:
            raise ValueError(f"%{letter} is not supported")
        elif letter is not None:
            found.append(("", letter))
    return found


def _java(tokens: list[Token]) -> str:
    """The same as a pattern of the session's formatter."""
    out = ""
    for letter, group in groupby(tokens, lambda t: t[0]):
        for n in ["".join(x for _, x in group)] if not letter else [n for _, n in group]:
            out += _java_part(letter, n)
    return out


def _java_part(letter: str, n: int | str) -> str:
    if not letter:
        return "'" + n.replace("'", "''") + "'" if any(x.isalpha() or x in "[]{}#'" for x in n) else n
    if letter in "Yy":
        return "y" * n
    if letter == "E":
        return "EEEE" if n > 3 else "EEE"
    if letter == "M":
        return "M" * min(n, 4)
    return "a" if letter == "a" else letter * n


def java_pattern(text: str) -> str:
    """A pattern of letters after % as the session's formatter has it."""
    tokens = percents(text)
    if any(letter in OWN for letter, _ in tokens if letter):
        raise ValueError("week-based parts have no such pattern")
    return _java(tokens)


def _own(letter: str, n: int, x: Column) -> Column:
    if letter == "z":
        return F.current_timezone()
    if letter == "Z":
        return F.current_timezone() if n > 2 else F.date_format(x, "xx" if n == 1 else "xxx")
    value = {
        "C": lambda: F.floor(F.year(x) / 100), "w": lambda: F.weekofyear(x), "e": lambda: F.weekday(x) + 1, "x": lambda: F.extract(F.lit("YEAROFWEEK"), x),
    }[letter]()
    value = F.pmod(value, F.lit(100)) if letter == "x" and n == 2 else value
    return F.format_string(f"%0{n}d", value.cast("bigint"))


def write(x: Column, tokens: list[Token]) -> Column:
    """A time as text."""
    parts = []
    for own, group in groupby(tokens, lambda t: bool(t[0]) and t[0] in OWN):
        some = list(group)
        parts += [_own(letter, n, x) for letter, n in some] if own else [F.date_format(x, _java(some))]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _number(tokens: list[Token]) -> Iterator[str]:
    for i, (letter, n) in enumerate(tokens):
        if not letter:
            yield "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in n)
        elif letter in "xweHmsS":
            beside = i + 1 < len(tokens) and tokens[i + 1][0]
            yield f"([0-9]{{{n}}})" if beside else "([0-9]+)"
        else:
            raise ValueError(f"{letter} can't stand beside a week")


def read(s: Column, tokens: list[Token]) -> Column:
    """Text as a time; text that isn't one in this pattern is an error."""
    letters = [letter for letter, _ in tokens if letter]
    if not any(letter in WEEK for letter in letters):
        return F.to_timestamp(s, _java(tokens))
    form = f"^{''.join(_number(tokens))}$"
    at = {letter: F.regexp_extract(s, form, i).cast("int") for i, letter in enumerate(letters, 1)}
    year, week, day = (at.get(letter, F.lit(default)) for letter, default in (("x", 2000), ("w", 1), ("e", 1)))
    fourth = F.make_date(year, F.lit(1), F.lit(4))  # always in the first week
    date = F.date_add(fourth, (week - 1) * 7 + day - 1 - F.weekday(fourth))
    fraction = {letter: n for letter, n in tokens if letter}.get("S", 0)
    seconds = at.get("s", F.lit(0)).cast("decimal(18,6)") + (at["S"] / F.lit(10**fraction) if "S" in at else F.lit(0)).cast("decimal(18,6)")
    time = date.cast("timestamp") + F.make_dt_interval(F.lit(0), at.get("H", F.lit(0)), at.get("m", F.lit(0)), seconds.cast("decimal(18,6)"))
    fits = F.regexp_like(s, F.lit(form)) & week.between(1, 53) & day.between(1, 7)
    return F.when(s.isNull(), F.lit(None)).when(fits, time).otherwise(F.raise_error(F.concat(F.lit("not a time in this pattern: "), s)).cast("timestamp"))

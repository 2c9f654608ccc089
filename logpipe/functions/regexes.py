"""Regular expressions: RE2 -> Java translation, validation, one-pass extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# RE2's \s and \S, spelled out (Java's \s also matches \x0B).
WS = r"[\t\n\f\r ]"
NWS = r"[^\t\n\f\r ]"
SEP = "\u0001"

_POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}",
    "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}",
    "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}",
    "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}",
    "word": r"\w", "xdigit": r"\p{XDigit}",
}


def builtin(pattern: str) -> str:
    """Java form of a built-in RE2-style pattern.

    ``(?d)`` makes ``.`` stop only at ``\\n`` as in RE2; ``\\s``/``\\S`` become
    RE2's exact classes.
    """
    return "(?d)" + pattern.replace(r"\s", WS).replace(r"\S", NWS)


_SPACES = r"\t\n\f\r "
_NOT_SPACES = r"\x00-\x08\x0B\x0E-\x1F\x21-\x{10FFFF}"
_REPEAT = re.compile(r"\{(\d+)(,(\d*))?\}")
_FLAGS = re.compile(r"\(\?([imsU]*)(-([imsU]+))?([:)])")
_NAME = re.compile(r"\(\?P?<(\w+)>", re.ASCII)
_CLASS_NAME = re.compile(r"\[:(\^?)([a-z]+):\]")


class _Translator:
    """Reads an RE2 pattern token by token and writes each token as Java means it."""

    def __init__(self, pattern: str):
        self.text, self.at, self.out = pattern, 0, []
        self.multiline = [False]  # (?m) of each open group
        self.names = 0

    def run(self) -> str:
        repeated = False  # whether the last token was a repetition
        while self.at < len(self.text):
            ch = self.text[self.at]
            is_repeat = ch in "*+?" or ch == "{" and _REPEAT.match(self.text, self.at) is not None
            if is_repeat:
                if repeated:
                    raise ValueError("invalid nested repetition operator")
                self._repeat(ch)
            elif ch == "\\":
                self.out.append(self._escape(False))
            elif ch == "[":
                self._class()
            elif ch == "(":
                self._group()
            elif ch == ")":
                if len(self.multiline) > 1:
                    self.multiline.pop()
                self._copy(1)
            elif ch == "$":
                self.out.append("$" if self.multiline[-1] else r"\z")
                self.at += 1
            elif ch == "^":
                self.out.append(r"(?:^|(?<=\n))" if self.multiline[-1] else "^")
                self.at += 1
            elif ch in "{}":
                self.out.append("\\" + ch)
                self.at += 1
            else:
                self._copy(1)
            repeated = is_repeat
        return "".join(self.out)

    def _copy(self, n: int) -> None:
        self.out.append(self.text[self.at:self.at + n])
        self.at += n

    def _repeat(self, ch: str) -> None:
        m = _REPEAT.match(self.text, self.at)
        if ch == "{":
            if max(int(m.group(1)), int(m.group(3) or 0)) > 1000:
                raise ValueError("invalid repeat count")
            self._copy(len(m.group(0)))
        else:
            self._copy(1)
        if self.text[self.at:self.at + 1] == "?":
            self._copy(1)

    def _group(self) -> None:
        name = _NAME.match(self.text, self.at)
        flags = _FLAGS.match(self.text, self.at)
        if name:
            # Java names have no "_"; numbering keeps different names different
            self.names += 1
            clean = re.sub("[^A-Za-z0-9]", "", name.group(1))
            self.out.append(f"(?<g{self.names}x{clean}>")
            self.at = name.end()
            self.multiline.append(self.multiline[-1])
        elif flags:
            on, off, end = flags.group(1), flags.group(3) or "", flags.group(4)
            if "U" in on + off:
                raise ValueError("flag (?U) has no Java equivalent")
            multiline = self.multiline[-1] and "m" not in off or "m" in on
            # case folding is Unicode's in RE2, ASCII's in Java without "u"
            on, off = (x + "u" if "i" in x else x for x in (on, off))
            self.out.append("(?" + on + ("-" + off if off else "") + end)
            self.at = flags.end()
            if end == ":":
                self.multiline.append(multiline)
            else:
                self.multiline[-1] = multiline
        elif self.text.startswith("(?", self.at):
            raise ValueError("invalid or unsupported group syntax")
        else:
            self._copy(1)
            self.multiline.append(self.multiline[-1])

    def _escape(self, in_class: bool) -> str:
        text, at = self.text, self.at
        if at + 1 >= len(text):
            raise ValueError("trailing backslash at end of expression")
        ch = text[at + 1]
        self.at += 2
        if ch == "s":
            return _SPACES if in_class else WS
        if ch == "S":
            return _NOT_SPACES if in_class else NWS
        if ch in "dDwWafnrt":
            return "\\" + ch
        if ch == "v":
            return r"\x0B"
        if ch in "pP":
            return self._property(ch)
        if ch == "x":
            m = re.compile(r"\{[0-9A-Fa-f]{1,6}\}|[0-9A-Fa-f]{2}").match(text, self.at)
            if not m:
                raise ValueError("invalid escape sequence")
            self.at = m.end()
            return r"\x" + m.group(0)
        if ch in "01234567":
            m = re.compile("[0-7]{1,3}").match(text, at + 1)
            if ch != "0" and len(m.group(0)) < 2:
                raise ValueError("invalid escape sequence")
            self.at = m.end()
            return rf"\x{{{int(m.group(0), 8):x}}}"
        if not in_class and ch in "AbBz":
            return "\\" + ch
        if not in_class and ch == "Q":
            end = text.find(r"\E", self.at)
            literal = text[self.at:] if end < 0 else text[self.at:end]
            self.at = len(text) if end < 0 else end + 2
            return "".join(_quoted(c) for c in literal)
        if ch.isalnum() and ch.isascii():
            raise ValueError(f"invalid escape sequence \\{ch}")
        return _quoted(ch)

    def _property(self, ch: str) -> str:
        m = re.compile(r"\{(\^?)(\w+)\}|(\w)").match(self.text, self.at)
        if not m:
            raise ValueError("invalid character class range")
        self.at = m.end()
        name = m.group(2) or m.group(3)
        if m.group(1):
            ch = "P" if ch == "p" else "p"
        return f"\\{ch}{{{name if len(name) <= 2 else 'Is' + name}}}"

    def _class(self) -> None:
        out = ["["]
        self.at += 1
        if self.text[self.at:self.at + 1] == "^":
            out.append("^")
            self.at += 1
        first = True
        while True:
            if self.at >= len(self.text):
                raise ValueError("missing closing ]")
            ch = self.text[self.at]
            named = _CLASS_NAME.match(self.text, self.at)
            if ch == "]" and not first:
                break
            if named:
                out.append(_posix(named.group(1), named.group(2)))
                self.at = named.end()
            elif ch == "\\":
                out.append(self._escape(True))
            else:
                # "[", "&", "^" and "]" mean something inside a Java class only
                out.append("\\" + ch if ch in "[]&^" else ch)
                self.at += 1
            first = False
        self.at += 1
        self.out.append("".join(out) + "]")


def _quoted(ch: str) -> str:
    return ch if ch.isalnum() or not ch.isascii() or ch == "_" else "\\" + ch


def _posix(negated: str, name: str) -> str:
    if name not in _POSIX:
        raise ValueError(f"unknown POSIX class [:{name}:]")
    cls = _POSIX[name]
    return cls if not negated else cls.replace(r"\p", r"\P") if cls.startswith(r"\p") else r"\W"


def re2_to_java(pattern: str) -> str:
    """Translate a user RE2 pattern into the Java dialect Spark runs.

    ``(?d)`` makes ``.`` stop only at ``\\n``.  What RE2 rejects
    (look-around, back-references, nested repetition) is rejected here too;
    so is ``(?U)``, "ungreedy" in RE2 and something else in Java.
    """
    return "(?d)" + _Translator(pattern).run()


def validate(spark: SparkSession | None, java_pattern: str, field: str) -> str:
    """Compile on the driver so a bad pattern fails the build, not the job."""
    jvm = getattr(spark, "_jvm", None) if spark is not None else None
    if jvm is not None:
        try:
            jvm.java.util.regex.Pattern.compile(java_pattern)
            return java_pattern
        except Exception as e:  # py4j error carries the Java message
            msg = str(e).splitlines()[-1] if str(e) else repr(e)
            raise ValueError(f"{field}: {msg}") from None
    try:
        re.compile(java_pattern.replace("(?d)", "", 1))
    except re.error as e:
        raise ValueError(f"{field}: {e}") from None
    return java_pattern


def user_regex(spark: SparkSession | None, pattern: str, field: str) -> str:
    try:
        java = re2_to_java(pattern)
    except ValueError as e:
        raise ValueError(f"{field}: {e}") from None
    return validate(spark, java, field)


def extract_groups(s: Column, pattern: str, n: int) -> Column:
    """All ``n`` groups of an anchored, whole-line ``pattern`` in one regex pass.

    Returns ``array<string>`` (unmatched optional groups are ``""``) or NULL
    when the line does not match.  The line is rewritten to
    ``SEP g1 SEP g2 ...`` and split; a line that itself contains ``SEP``
    takes the slower per-group path so the marker stays unambiguous.
    """
    template = SEP + SEP.join(f"${i}" for i in range(1, n + 1))
    rewritten = F.regexp_replace(s, pattern, template)
    fast = F.when(rewritten.startswith(SEP), F.split(F.substr(rewritten, F.lit(2)), SEP, -1))
    slow = F.when(s.rlike(pattern),
                  F.array(*[F.regexp_extract(s, pattern, i) for i in range(1, n + 1)]))
    return F.when(s.contains(SEP), slow).otherwise(fast)


def names_matching(spark: SparkSession, java_pattern: str, names: list[str]) -> list[str]:
    """Which names a translated pattern finds, decided by the dialect that also runs on the data."""
    row = spark.range(1).select(*[F.lit(n).rlike(java_pattern).alias(n) for n in names]).first()
    return [n for n in names if row[n]]

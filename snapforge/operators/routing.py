"""Which codec a file goes to: rules in order, the first that accepts wins, else the fallback. All as one CASE."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from snapforge.functions.scalars import header

PASSTHROUGH, BINARY, TEXT, EXTENDED = 0, 1, 2, 255


def glob_regex(pattern: str, braces: bool = False) -> str:
    """A regular expression for a whole path. ``*`` and ``?`` match ``/`` too; ``**`` stands for whole folders, any number of
    them; ``[...]`` and ``[!...]`` are classes. Braces are literal unless asked for."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i) and (i == 0 or pattern[i - 1] == "/") and i + 2 == len(pattern):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "!" else 2))) > 0:
            body = pattern[i + 1 : end]
            not_ = body.startswith("!")
            out.append("[" + "^" * not_ + re.sub(r"([\\\[\]^&~])", r"\\\1", body[not_:]) + "]")
            i = end
        elif braces and c == "{" and (end := pattern.find("}", i)) > 0:
            out.append("(?:" + "|".join(glob_regex(p) for p in pattern[i + 1 : end].split(",")) + ")")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    """An own rule: any condition over the columns path, size and header. Its code may be a router, which then decides."""

    condition: object
    code: int | Router
    codec_id: str | None = None

    def accepts(self) -> Column:
        return self.condition


@dataclass(frozen=True)
class Glob(Rule):
    braces: bool = False

    def accepts(self) -> Column:
        return F.rlike(F.col("path"), F.lit(f"(?s)^{glob_regex(self.condition, self.braces)}$"))


class Elf(Rule):
    def __init__(self, code: int | Router, codec_id: str | None = None):
        super().__init__(None, code, codec_id)

    def accepts(self) -> Column:
        return F.startswith(F.col("header"), F.unhex(F.lit("7f454c46")))


class Size(Rule):
    """Up to so many bytes, that number included."""

    def accepts(self) -> Column:
        return F.col("size") <= F.lit(int(self.condition))


class Magic(Rule):
    """The first bytes, in hex."""

    def accepts(self) -> Column:
        return F.startswith(F.col("header"), F.unhex(F.lit(self.condition)))


@dataclass(frozen=True)
class Router:
    """Rules and a fallback, each with a code or with a further router, whose rules and threshold then hold as well."""

    rules: tuple = ()
    fallback: int | Router = BINARY
    threshold: float = 1.0
    #: decoders by (code, id), for codes and ids that are not built in
    extended: dict = field(default_factory=dict)

    def _chosen(self, of_router, of_rule, fallback) -> Column:
        """What the first rule that accepts gives, or the fallback."""
        out = of_router(self.fallback) if isinstance(self.fallback, Router) else fallback()
        for r in reversed(self.rules):
            out = F.when(r.accepts(), of_router(r.code) if isinstance(r.code, Router) else of_rule(r)).otherwise(out)
        return out

    def code(self) -> Column:
        return self._chosen(Router.code, lambda r: F.lit(r.code), lambda: F.lit(self.fallback))

    def codec_id(self) -> Column:
        return self._chosen(Router.codec_id, lambda r: F.lit(r.codec_id).cast("string"), lambda: F.lit(None).cast("string"))

    def limit(self) -> Column:
        """The least threshold among the routers that a file goes through."""
        own = F.lit(float(self.threshold))
        return self._chosen(lambda x: F.least(own, x.limit()), lambda r: own, lambda: own)

    def decoders(self) -> dict:
        """The codecs of this router and of those below it; its own come first."""
        below = [x for x in (*[r.code for r in self.rules], self.fallback) if isinstance(x, Router)]
        return {i: c for x in reversed(below) for i, c in x.decoders().items()} | self.extended

    def rule_number(self) -> Column:
        """The place of the rule that accepts, from 0; -1 for the fallback."""
        out = F.lit(-1)
        for n, r in reversed(list(enumerate(self.rules))):
            out = F.when(r.accepts(), F.lit(n)).otherwise(out)
        return out

    def verbatim(self, patch_bytes, size) -> Column:
        """Whether content goes verbatim as its patch is too large: strictly over the threshold."""
        return F.col(patch_bytes) > F.col(size) * self.limit()

    def knows(self, code, codec_id) -> Column:
        """Whether there is a decoder; code 0 always has one."""
        known = F.lit(False)
        for i in self.decoders():
            known = known | (F.col(codec_id) == F.lit(i))
        return F.col(code).isin(PASSTHROUGH, BINARY, TEXT) | ((F.col(code) == EXTENDED) & F.coalesce(known, F.lit(False)))

    @staticmethod
    def from_config(config: dict) -> Router:
        """From a mapping like that of a TOML file: default_encoder, passthrough_threshold, rules (type, pattern, encoder). An
        encoder is a name, or a mapping of the same form for a router within this one."""
        codes = {"passthrough": PASSTHROUGH, "xdelta3": BINARY, "binary": BINARY, "text": TEXT, "text_diff": TEXT}
        kinds = {"glob": lambda r, c: Glob(r["pattern"], c), "elf": lambda r, c: Elf(c), "size": lambda r, c: Size(r["max_bytes"], c), "magic": lambda r, c: Magic(r["magic"], c)}

        def encoder(x, problem):
            if isinstance(x, dict):
                return Router.from_config(x)
            if x not in codes:
                raise ValueError(problem)
            return codes[x]

        rules = []
        for r in config.get("rules", []):
            if r.get("type") not in kinds:
                raise ValueError(f"unknown rule {r}")
            if r["type"] == "magic":
                bytes.fromhex(r["magic"])
            rules.append(kinds[r["type"]](r, encoder(r.get("encoder"), f"unknown rule {r}")))
        default = config.get("default_encoder", "binary")
        return Router(tuple(rules), encoder(default, f"unknown encoder {default}"), float(config.get("passthrough_threshold", 1.0)))

    @staticmethod
    def from_file(path: str) -> Router:
        import tomllib

        with open(path, "rb") as f:
            return Router.from_config(tomllib.load(f).get("compressor", {}))

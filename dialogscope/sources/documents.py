"""Nested documents that people write (maps, lists, block and quoted scalars by indentation) as VARIANT, and typed views of them.

The reader knows the part of YAML 1.1 that such files use: block and flow maps and lists, plain, quoted, literal (``|``) and folded (``>``) scalars,
plain scalars over several lines, comments. Anchors, tags, several documents and complex keys are errors of that document, not of the job.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},#&*!|>'"%@`-][^:#]*?|-[^\s:][^:#]*?|[^\s:#'"\[{][^:#]*?(?::[^\s:#][^:#]*?)*)\s*:(?=\s|$)""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " ", "b": "\b", "f": "\f", "a": "\a", "v": "\v", "e": "\x1b"}
_SPACE = re.compile(r"(?:\s|(?:^|(?<=\s))#[^\n]*)*")
_QUOTED = {'"': re.compile(r'"((?:[^"\\]|\\.)*)"', re.S), "'": re.compile(r"'((?:[^']|'')*)'", re.S)}
# words that are read in one step: a whole line's rest, and one before the end of a flow entry
_WORD = r"([A-Za-z0-9_][A-Za-z0-9_./-]*)"
_LINE = re.compile(_WORD + r"(?:[ \t]+#.*)?")
_ENTRY = {stop: re.compile(rf" *{_WORD}(?= *[{re.escape(stop)}])") for stop in (",]", ":,}", ",}")}
# flow collections of such words alone, and what they hold
_SHORT = {"[": re.compile(rf"\[ *{_WORD}(?: *, *{_WORD})* *\]"), "{": re.compile(rf"\{{ *{_WORD} *: *{_WORD}(?: *, *{_WORD} *: *{_WORD})* *\}}")}
_WORDS_IN, _PAIRS_IN = re.compile(_WORD), re.compile(rf"{_WORD} *: *{_WORD}")
# what each line begins with: indentation, a simple key, the word that is its value, else whatever follows the key
_HEAD = re.compile(rf"^( *+)(?:([A-Za-z0-9_][A-Za-z0-9_.-]*+):(?:[ \t]++(?:{_WORD}(?=[ \t]*+$|[ \t]++#))?(.*+))?$|.*+)", re.M)
_END = ("", "\n", "", "")
_DASH = re.compile(r"-(\s|$)")
_LITERAL = re.compile(r"([|>])([-+]?)\s*(#.*)?$")
_NUMBER = re.compile(r"[-+]?(?:(0|[1-9][0-9_]*)|(?:\d[\d_]*\.\d*|\.\d+)(?:[eE][-+]\d+)?|\.[eE][-+]\d+)")
_JSON = json.JSONEncoder(ensure_ascii=False).encode
_PLAIN = {stop: re.compile(rf"[^{re.escape(stop)}\n]*?(?=\s+#|\s*[{re.escape(stop)}\n]|\s*$)" if stop else r".*?(?=\s+#|\s*$)", re.S) for stop in ("", *_ENTRY)}
# The plain words that are not text.
WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None} | {w: v for v, group in ((True, "true True TRUE yes Yes YES on On ON"), (False, "false False FALSE no No NO off Off OFF")) for w in group.split()}


def _folded(text: str) -> str:
    """Lines of a scalar as one: a break is a space, each empty line a break."""
    return re.sub(r"[ \t]*\n[ \t]*((?:\n[ \t]*)*)", lambda m: "\n" * m[1].count("\n") or " ", text)


def _plain(text: str):
    if text in WORDS:
        return WORDS[text]
    if text[0].isalpha():
        return text
    if m := _NUMBER.fullmatch(text):
        return int(text.replace("_", "")) if m[1] else float(text.replace("_", ""))
    if text[0] in "&*!%@`":
        raise ValueError(f"not supported: {text[:20]!r}")
    return text


def _of_words(short: str) -> list | dict:
    """A flow collection of words alone."""
    if short[0] == "[":
        return [_plain(w) for w in _WORDS_IN.findall(short)]
    return {str(_plain(k)): _plain(v) for k, v in _PAIRS_IN.findall(short)}


class _Flow:
    """Scalars and flow collections from one string."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _skip(self) -> str:
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def quoted(self) -> str:
        q = self.text[self.at]
        m = _QUOTED[q].match(self.text, self.at)
        if not m:
            raise ValueError("a quote is not closed")
        self.at, body = m.end(), _folded(m[1])
        if q == "'":
            return body.replace("''", "'")
        return re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", lambda e: chr(int(e[1][1:], 16)) if e[1][0] in "ux" and len(e[1]) > 1 else _ESCAPES[e[1]], body)

    def value(self, stop: str):
        if stop and (m := _ENTRY[stop].match(self.text, self.at)):
            self.at = m.end()
            return _plain(m[1])
        c = self._skip()
        if c and c in "\"'":
            return self.quoted()
        if c and c in "[{":
            return self._many(c)
        m = _PLAIN[stop].match(self.text, self.at)
        self.at = m.end()
        if re.search(r":(\s|$)", m[0]):
            raise ValueError("a map inside a plain scalar")
        return _plain(_folded(m[0]).strip())

    def _many(self, opening: str):
        if m := _SHORT[opening].match(self.text, self.at):
            self.at = m.end()
            return _of_words(m[0])
        closing, out = ("]", []) if opening == "[" else ("}", {})
        self.at += 1
        while self._skip() != closing:
            if self.at >= len(self.text):
                raise ValueError(f"{opening} is not closed")
            if opening == "[":
                out.append(self.value(",]"))
            else:
                k = self.value(":,}")
                out[str(k)] = None
                if self._skip() == ":":
                    self.at += 1
                    out[str(k)] = self.value(",}")
            if self._skip() == ",":
                self.at += 1
        self.at += 1
        return out

    def whole(self):
        out = self.value("")
        if self._skip():
            raise ValueError(f"text after a value: {self.text[self.at : self.at + 20]!r}")
        return out


class _Block:
    """Block collections from lines."""

    def __init__(self, text: str):
        text = text.replace("\r\n", "\n")
        self.lines, self.heads, self.i = text.split("\n"), _HEAD.findall(text), 0
        if not self.lines[-1]:
            self.heads.pop()
        self.heads += [_END] * 3

    def _next(self) -> int:
        """The indentation of the next line with content, or -1."""
        while self.i < len(self.lines):
            line = self.lines[self.i]
            if line.strip() and not line.lstrip().startswith("#") and not (line == "---" and self.i == 0):
                indent = len(line) - len(line.lstrip(" "))
                if line[indent] == "\t":
                    raise ValueError(f"line {self.i + 1}: a tab indents")
                return indent
            self.i += 1
        return -1

    def node(self, least: int):
        space, k, _, _ = self.heads[self.i]
        if k and k != "\n" and len(space) >= least:
            return self._map(len(space))
        indent = self._next()
        if indent < least:
            return None
        rest = self.lines[self.i][indent:]
        if rest == "-" or rest.startswith("- "):
            return self._list(indent)
        return self._map(indent) if _KEY.match(rest) else self._scalar(rest, least - 1)

    def _list(self, indent: int) -> list:
        out = []
        while self._next() == indent and _DASH.match(self.lines[self.i], indent):
            rest = self.lines[self.i][indent + 1 :].lstrip(" ")
            if rest and not rest.startswith("#") and (_KEY.match(rest) or _DASH.match(rest)):
                # what follows the dash is a block of its own, indented by where it stands
                self.lines[self.i] = " " * (len(self.lines[self.i]) - len(rest)) + rest
                self.heads[self.i] = _HEAD.match(self.lines[self.i]).groups("")
                out.append(self.node(indent + 1))
            else:
                out.append(self._scalar(rest, indent))
        if self._next() > indent:
            raise ValueError(f"line {self.i + 1}: indentation")
        return out

    def _map(self, indent: int) -> dict:
        out: dict = {}
        heads, same = self.heads, " " * indent
        while True:
            space, k, word, rest = heads[self.i]
            below, following, _, _ = heads[self.i + 1]
            # before another key, or the end, nothing else can belong to a value on its line
            if word and following and space == same and len(below) <= indent and k not in out:
                out[k] = _plain(word)
                self.i += 1
                continue
            if k and (k == "\n" or len(space) < indent):
                return out
            simple = k and following and space == same
            if not simple:
                if self._next() != indent or not (m := _KEY.match(self.lines[self.i][indent:])):
                    break
                k = str(_Flow(m[1]).whole() if m[1][0] in "\"'" else m[1])
            if k in out:
                raise ValueError(f"line {self.i + 1}: {k} stands twice")
            if not simple:
                out[k] = self._scalar(self.lines[self.i][indent:][m.end() :].strip(), indent, of_map=True)
                continue
            deeper, rest = len(below) > indent, rest.strip()
            if not word and (not rest or rest[0] == "#"):
                self.i += 1
                out[k] = self._map(len(below)) if deeper else None
            elif deeper or rest[0] in "|>":
                out[k] = self._scalar(self.lines[self.i][indent + len(k) + 1 :].strip(), indent, of_map=True)
            else:
                self.i += 1
                out[k] = _of_words(rest) if rest[0] in "[{" and _SHORT[rest[0]].fullmatch(rest) else _Flow(rest).whole()
        if self._next() >= indent:
            raise ValueError(f"line {self.i + 1}: neither a key nor the end of a map")
        return out

    def _scalar(self, rest: str, indent: int, of_map: bool = False):
        """The value that begins with ``rest`` on this line and belongs to something at ``indent``."""
        self.i += 1
        if not rest or rest.startswith("#"):
            below = self._next()
            same_list = of_map and below == indent and _DASH.match(self.lines[self.i], indent)
            return self.node(indent if same_list else indent + 1)
        if m := _LITERAL.match(rest):
            return self._literal(m[1], m[2], indent)
        parts = [rest]
        while self.i < len(self.lines) and (not self.lines[self.i].strip() or len(self.lines[self.i]) - len(self.lines[self.i].lstrip(" ")) > indent):
            if self.lines[self.i].lstrip().startswith("#") and rest[0] not in "\"'[{":
                break
            parts.append(self.lines[self.i].strip())
            self.i += 1
        if len(parts) == 1 and (m := _LINE.fullmatch(rest)):
            return _plain(m[1])
        return _Flow("\n".join(parts).rstrip("\n")).whole()

    def _literal(self, style: str, keep: str, indent: int) -> str:
        body = []
        while self.i < len(self.lines) and (not self.lines[self.i].strip() or len(self.lines[self.i]) - len(self.lines[self.i].lstrip(" ")) > indent):
            body.append(self.lines[self.i])
            self.i += 1
        if body and self.i == len(self.lines) and not body[-1]:
            body.pop()  # what follows the last break is no line
        depth = min((len(x) - len(x.lstrip(" ")) for x in body if x.strip()), default=0)
        lines = [x[depth:] for x in body]
        tail = len(lines) - len("\n".join(lines).rstrip("\n").split("\n")) if any(x.strip() for x in lines) else len(lines)
        lines = lines[: len(lines) - tail]
        if style == "|":
            text = "\n".join(lines)
        else:
            # single breaks become spaces, except beside lines that are indented further
            text = re.sub(r"(?<=[^\n])\n(\n*)(?=[^\n])", lambda m: m[1] or " ", "\n".join(lines))
            text = "\n".join(lines) if any(x.startswith((" ", "\t")) for x in lines) else text
        ends = {"-": 0, "+": tail + 1, "": 1}[keep]
        return text + "\n" * (ends if lines else 0)


def parsed(text: str | None) -> tuple[str | None, str | None]:
    """(JSON, error) of a document."""
    try:
        reader = _Block(text or "")
        out = reader.node(0)
        if reader._next() >= 0:
            raise ValueError(f"line {reader.i + 1}: text after the document")
        return _JSON(out), None
    except (ValueError, KeyError, RecursionError) as e:
        return None, str(e) or type(e).__name__


def nested(text: Column | str) -> Column:
    """struct<document: variant, error: string>; an empty or null text is a document that is null."""

    @F.pandas_udf("json string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parsed(t) for t in texts], columns=["json", "error"])

    found = run(F.col(text) if isinstance(text, str) else text)
    return F.transform(F.array(found), lambda x: F.struct(F.try_parse_json(x["json"]).alias("document"), x["error"].alias("error")))[0]


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """file, document (VARIANT), sha256, error of every file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.select("file", F.sha2("value", 256).alias("sha256"), nested("value").alias("n")).select("file", "n.document", "sha256", "n.error")


# The keys of a configuration and their types.
CONFIGURATION = {
    "providers": "map<string,string>", "roles.advisors": "array<string>", "roles.patient": "string", "roles.judge_panel": "int",
    "sampling": "map<string,struct<temperature:double,max_tokens:int>>", "seed": "long",
}
OPTIONAL = {"roles.patient_model": "string", "roles.guard_model": "string", "provider_pins": "map<string,array<string>>"}


def configuration(documents: DataFrame, document: str = "document") -> DataFrame:
    """Typed columns of configurations, named after the last part of their keys, and ``errors``: keys that are missing or of another type, providers that roles name in vain."""
    cast = lambda k, t: F.try_variant_get(document, f"$.{k}", t).alias(k.rpartition(".")[2])
    out = documents.select("*", *[cast(k, t) for k, t in (CONFIGURATION | OPTIONAL).items()])
    missing = F.filter(F.array(*[F.when(F.col(k.rpartition(".")[2]).isNull(), F.lit(f"missing or invalid: {k}")) for k in CONFIGURATION]), lambda x: x.isNotNull())
    half = F.transform(F.filter(F.map_entries("sampling"), lambda e: e["value"]["temperature"].isNull() | e["value"]["max_tokens"].isNull()), lambda e: F.concat(F.lit("missing or invalid: sampling."), e["key"]))
    named = F.array_distinct(F.concat("advisors", F.array("patient")))
    absent = F.transform(F.array_sort(F.array_except(named, F.map_keys("providers"))), lambda x: F.concat(F.lit("not among providers: "), x))
    none = F.array().cast("array<string>")
    return out.withColumn("errors", F.concat(missing, F.coalesce(half, none), F.coalesce(absent, none)))


def require_configuration(documents: DataFrame, document: str = "document") -> DataFrame:
    """``configuration``; any error fails."""
    out = configuration(documents, document)
    bad = out.where(F.size("errors") > 0).select("errors").limit(3).collect()
    if bad:
        raise ValueError("; ".join(e for r in bad for e in r["errors"]))
    return out.drop("errors")


def families(documents: DataFrame, document: str = "document") -> DataFrame:
    """(version, id, name, scenario, pairings, family VARIANT), a row a family of ``families:``."""
    rows = documents.select(F.try_variant_get(document, "$.version", "long").alias("version"), F.explode(F.try_variant_get(document, "$.families", "array<variant>")).alias("family"))
    get = lambda k, t: F.try_variant_get("family", f"$.{k}", t).alias(k)
    return rows.select("version", get("id", "long"), get("name", "string"), get("scenario", "string"), get("pairings", "map<string,string>"), "family")


def scenario(family: Column, pairings: Column, vignette_id: Column) -> Column:
    """A family's scenario with the clause for a vignette after it, if it has one."""
    clause = F.nullif(F.try_element_at(pairings, vignette_id.cast("string")), F.lit(""))
    return F.when(clause.isNotNull(), F.trim(F.concat(family, F.lit(" "), clause))).otherwise(family)

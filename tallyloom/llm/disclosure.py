"""Personal details in free text: information-theoretic sanitisation.

One pass over the texts takes down candidates: runs of digits, pairs of words
that hold a given name or an initial, a house number with a street, things in
the form of an e-mail address. Each candidate consists of terms: the shape of
a number, its cue and the words around it, the family name, the street, the host
and the local part of an e-mail address. How strongly a term reveals a protected
entity is estimated from the whole corpus, by how much more often the term stands
together with what is known to be one (a cue word, a listed given name, a house
number, an @) than without: no form is a detail by itself, and a listed name only
begins with a better estimate. Candidates whose terms disclose more than the
threshold, in bits, are details; they are generalised to a placeholder of their
kind.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.textform import LOOK_ALIKE, ZERO_WIDTH, hash_words
from tallyloom.storage import materialise

# Words by which a text presents a number as a phone number, or
# as the number of a person's document.
PHONE_CUES = {"call", "calls", "ring", "tel", "telephone", "phone", "mobile", "cell", "whatsapp", "text", "sms", "fax"}
ID_CUES = {"passport", "licence", "license", "social", "ssn", "insurance", "ni", "tax", "taxpayer", "identity", "id", "citizen", "personal", "tin", "nino"}
# Kinds of streets and parts of a house.
STREETS = "street st avenue ave road rd lane ln drive dr court ct close place square terrace boulevard blvd crescent way"
STREETS_BEFORE = "rue avenue boulevard allée chemin impasse quai place calle avenida plaza paseo via viale piazza"
PARTS = "flat apt apartment unit suite room floor"
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = "no nr num tel ph ext mr mrs ms dr st art".split()
# Short words that stand before a number without being part of it.
SHORT_WORDS = "am an as at be by do go he id if in is it me my no nr of on or so to up us we".split()
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

#: Bits of disclosure from which a candidate is a detail.
THRESHOLD = 0.0
#: Share of a term's occurrences that stand in the protected form, from which on
#: the term reveals it: next to given names (family), next to listed family names
#: (given), in addresses (a word of the street's name in any form of address, or its
#: last one, of its occurrences before a kind of street), in e-mail addresses (host, words of the local part, and the
#: top-level domain of an address that is written out in words). Half of it is
#: assumed of a term before anything is known, and more of listed family names.
REVEALS = {"family": 0.25, "given": 0.4, "street": 0.4, "way": 0.2, "host": 0.25, "local": 0.25, "tld": 1 / 64}
ASSUMED_LISTED = 0.9
#: What an address without town, flat or postcode tells of its street if it is
#: written with a capital; without, it tells nothing.
BARE_ADDRESS = 0.5
#: Fewest and most digits of a phone or identity number; the fewest are one less
#: with letters among them.
DIGITS, MOST_DIGITS = 7, 18
#: Words of a sentence in which a number's cue is looked for: those of a document
#: before it, those of a phone before and behind it.
ID_REACH, PHONE_REACH, PHONE_REACH_BEHIND = 4, 2, 3
#: Occurrences that the assumed share of a term counts as.
PRIOR_WEIGHT = 2.0

_DROP = set(ZERO_WIDTH)
_GAP = r"(?:[ \t\r\n]{0,3}(?:\.\.\.|[-–—/*()]|\.(?=[\w]))?[ \t\r\n*]{0,3})"
_NUMBER = re.compile(
    rf"(?<![\w@#$€£.,:/+-])(?:[+(]{{0,2}}(?:(?!(?i:{'|'.join(SHORT_WORDS)})\b)[A-Za-z]{{2}}{_GAP}|[A-Za-z]-?)?\d++(?>{_GAP}\(?\d++)*)(?:(?<=\d\d)(?:-?[A-Za-z]|{_GAP}[B-HJ-Z])(?![\w]))?(?![\w@])", re.UNICODE
)
_EXTENSION = re.compile(r"^\s*(?:ext|x)\.?\s*\d+", re.IGNORECASE)
_SENTENCE_END = re.compile(r"[.!?]+[\"'”’)\]*_]*(?:\s|$)|\n\s*\n")
_LAST_WORD = re.compile(r"([^\W\d_]+)\Z")
_GROUP = re.compile(r"\d+")
_PIECE = re.compile(r"[A-Za-z]+|\d+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_MAIL = re.compile(r"[A-Za-z0-9][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_AT = r"(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+(?:at|@)\s+)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\.)"
_SPELLED = re.compile(rf"(?<![\w@])([A-Za-z0-9][\w.%+-]*){_AT}([A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*){_DOT}([A-Za-z]{{2,}})(?![\w-])", re.IGNORECASE)
_SPELLED_DOT = re.compile(_DOT, re.IGNORECASE)
_HOST = re.compile(r"(?<![\w.-])[a-z0-9][\w-]*+(?:\.[\w-]++)*?\.[a-z]{2,}+(?![\w-]|\.\w)")
_MAIL_HOST = re.compile(r"(?<=@)[a-z0-9-]+(?:\.[a-z0-9-]+)+")
_S = r"[ \t\r\n*]{1,4}"
_TOWN = rf"(?:,{_S}(?:[A-Z][\w’'-]*)(?:[ \t][A-Z][\w’'-]*)?(?:[ \t]\d{{4,5}})?)?"
_PART = rf"(?:{'|'.join(PARTS.split())})\.?{_S}\d+[A-Za-z]?"
_HOUSE_PART = re.compile(_PART, re.IGNORECASE)
_KINDS = frozenset(STREETS.split())
_ADDRESS = re.compile(
    rf"(?<![\w$€£#.,/-])(?:(?i:{_PART}),?{_S})?\d{{1,5}}[A-Za-z]?{_S}(?P<name>(?:[^\W\d_]+(?:['’-][^\W\d_]+)*{_S}){{1,3}})(?P<kind>(?i:{'|'.join(STREETS.split())}))(?!\w)\.?(?:,{_S}(?i:{_PART}))?{_TOWN}"
)
_ADDRESS_BEFORE = re.compile(
    rf"(?<![\w$€£#.,/-])(?:(?i:{_PART}),?{_S})?\d{{1,4}}(?:{_S}(?i:bis|ter|quater))?,?{_S}(?P<kind>(?i:{'|'.join(STREETS_BEFORE.split())})){_S}(?P<name>(?:(?i:de|du|des|la|le|les|del|los|las|di|della)\s+|(?i:de\s+l['’])\s*)*[^\W\d_]+(?:[ \t][A-Z][^\W\d_]+)?){_TOWN}"
)
_ADDRESS_AFTER = re.compile(
    rf"(?<![\w-])(?P<name>[^\W\d_]+(?:-[^\W\d_]+)*)(?P<kind>{_S}(?i:str)(?!\w)\.?|(?i:stra(?:ß|ss)e|gasse|allee|platz)){_S}\d{{1,4}}[a-z]?,?{_S}\d{{4,5}}(?:{_S}[A-Z][\w’'-]*)?(?:[ \t][A-Z][\w’'-]*)?"
)


def plain(text: str) -> tuple[str, list[int] | range]:
    """The text in plain characters, and where each of them comes from."""
    if text.isascii():
        return text, range(len(text))
    out, at = [], []
    for k, c in enumerate(text):
        if c > "\x7f":
            if c in _DROP:
                continue
            c = LOOK_ALIKE.get(c) or unicodedata.normalize("NFKC", c)
        out.append(c)
        at += [k] * len(c)
    return "".join(out), at


def _shape(piece: str) -> str:
    """Lengths of the groups of digits; letters as such."""
    groups = [("A" * len(x) if x.isalpha() else str(len(x))) for x in _PIECE.findall(piece)]
    shape = ("+" if piece.lstrip("(").startswith("+") else "") + ".".join(groups)
    return re.sub(r"(?<=\d)\.(?=A$)", "", shape)


def _digits(piece: str) -> int:
    return sum(c.isdigit() for c in piece)


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    """Where numbers with enough digits stand, without the brackets around them."""
    at = 0
    while m := _NUMBER.search(text, at):
        a, b = m.span()
        if _digits(m[0]) > MOST_DIGITS:
            # a row of numbers: as many whole groups as one number may have
            left = MOST_DIGITS
            for group in _GROUP.finditer(text, a, b):
                left -= len(group[0])
                if left < 0:
                    break
                b = group.end()
        at = max(b, a + 1)
        while text[a] == "(" and text.count("(", a, b) > text.count(")", a, b):
            a += 1
        if _digits(text[a:b]) >= DIGITS - any(c.isalpha() for c in text[a:b]):
            yield a, b


def _sentence_before(text: str, at: int) -> str:
    """What stands before a place in its sentence, at most 80 characters."""
    start = begin = max(0, at - 80)
    for m in _SENTENCE_END.finditer(text, begin, at):
        word = _LAST_WORD.search(text, begin, m.start())
        if not (text[m.start()] == "." and word and word[1].lower() in ABBREVIATIONS):
            start = m.end()
    return text[start:at]


def _cue(text: str, a: int, b: int) -> tuple[str, list[str], list[str], list[str]]:
    """What the nearest cue of a number's sentence presents it as, a term for
    that cue with its distance in words, and the words on either side."""
    before = [x.lower() for x in _WORD.findall(_sentence_before(text, a))]
    behind = _EXTENSION.sub("", text[b : b + 60])
    after = [x.lower() for x in _WORD.findall(_SENTENCE_END.split(behind, maxsplit=1)[0])[:PHONE_REACH_BEHIND]]
    cues = [(k, "id_number", w) for k, w in enumerate(reversed(before[-ID_REACH:]), 1) if w in ID_CUES]
    cues += [(k, "phone", w) for k, w in enumerate(reversed(before[-PHONE_REACH:]), 1) if w in PHONE_CUES]
    # behind a comma or a dash, a cue belongs to what follows
    if behind[:1].isspace() and behind.lstrip()[:1].isalpha():
        cues += [(k, "phone", w) for k, w in enumerate(after, 1) if w in PHONE_CUES]
    if cues:
        distance, label, _ = min(cues)
        return label, [f"cue:{label}{distance}"], before, after
    return ("phone" if text[a:b].lstrip("(").startswith("+") else ""), [], before, after


def _street(m: re.Match, before_kind: bool) -> tuple[str, list[str]]:
    """The label and the terms of an address."""
    name = _WORD.findall(m["name"])
    terms = ["street:" + x for x in sorted({x.lower() for x in name})]
    if before_kind:
        terms.append(f"way:{name[-1].lower()} *")
    rest = m[0].replace(m["name"], "", 1)
    if "," in rest or not before_kind or _HOUSE_PART.match(m[0]):
        return "whole", terms
    return ("bare" if name[-1].istitle() else ""), terms


def candidates(text: str, given: set[str], family: set[str]) -> list[tuple[str, int, int, str, list[str]]]:
    """(kind, start, end, label, terms) of one text; kind number may turn out
    as phone or id_number. The label is what a cue in the text says."""
    plainly, at = plain(text)
    out = []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    def add(kind: str, a: int, b: int, label: str, terms: list[str]) -> None:
        out.append((kind, at[a], at[b - 1] + 1, label, terms))

    if "@" in plainly:
        for m in _MAIL.finditer(plainly):
            taken.append(m.span())
            local, _, host = m[0].lower().partition("@")
            add("email", *m.span(), "email", ["host:" + host, "tld:." + host.rpartition(".")[2], *("local:" + x for x in set(_WORD.findall(local)))])
    lower = plainly.lower()
    if "dot" in lower or "(at" in lower or "[at" in lower or "@ " in lower:
        for m in _SPELLED.finditer(plainly):
            between = plainly[m.end(1) : m.start(3)].lower()
            if ("dot" in between or "[" in between or "(" in between or "@" in between) and free(*m.span()):
                taken.append(m.span())
                host = _SPELLED_DOT.sub(".", plainly[m.start(2) : m.end()].lower())
                add("email", *m.span(), "", ["host:" + host, "tld:." + m[3].lower()])

    if any(c.isdigit() for c in plainly):
        for pattern in (_ADDRESS_AFTER, _ADDRESS_BEFORE, _ADDRESS):
            for m in pattern.finditer(plainly):
                if free(*m.span()):
                    taken.append(m.span())
                    add("address", *m.span(), *_street(m, pattern is _ADDRESS))
        for a, b in _numbers(plainly):
            if not free(a, b):
                continue
            label, cue, before, after = _cue(plainly, a, b)
            words = [f"left{k}:{w}" for k, w in enumerate([*reversed(before[-3:]), "^"][:3], 1)] + [f"right{k}:{w}" for k, w in enumerate(after[:1], 1)]
            add("number", a, b, label, ["shape:" + _shape(plainly[a:b]), *cue, *words])

    tokens = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(plainly)]
    blank = re.compile(r"[ \t\r\n*_]{1,4}\Z").match
    k = 0
    while k < len(tokens):
        a, b, word = tokens[k]
        key = word.lower()
        initial = len(word) == 1 and plainly[b : b + 1] == "."
        if (key not in given and not initial and key not in family) or plainly[a - 1 : a] in ("@", "/", "#") or not free(a, b):
            k += 1
            continue
        if key in given:
            # family name behind, after an initial or not
            n = k + 1
            end = b
            if n < len(tokens) and len(tokens[n][2]) == 1 and blank(plainly[end : tokens[n][0]]):
                end = tokens[n][1] + (plainly[tokens[n][1] : tokens[n][1] + 1] == ".")
                n += 1
            if n < len(tokens) and blank(plainly[end : tokens[n][0]]):
                last = _double(plainly, tokens, n)
                # "Rose that" is no evidence, for its case
                label = "" if word[0].isupper() and tokens[n][2][0].islower() else key
                add("name", a, tokens[last][1], label, [f"family:{tokens[x][2].lower()}" for x in range(n, last + 1)])
            # family name before, with a comma
            if k and re.fullmatch(r",[ \t\r\n*]{1,4}", plainly[tokens[k - 1][1] : a]):
                first = k - 1
                while first and plainly[tokens[first - 1][1] : tokens[first][0]] == "-":
                    first -= 1
                add("name", tokens[first][0], b, "," + key, [f"family:{tokens[x][2].lower()}" for x in range(first, k)])
        elif initial and k + 1 < len(tokens):
            n = k + 1
            if blank(plainly[b + 1 : tokens[n][0]]) and not (k and tokens[k - 1][2].lower() in given):
                last = _double(plainly, tokens, n)
                add("name", a, tokens[last][1], "." + key, [f"family:{tokens[x][2].lower()}" for x in range(n, last + 1)])
        elif key in family and k and blank(plainly[tokens[k - 1][1] : a]) and len(tokens[k - 1][2]) > 1:
            before = tokens[k - 1]
            if before[2].lower() not in given and plainly[before[0] - 1 : before[0]] not in ("@", "/", "#"):
                add("name", before[0], b, key, ["given:" + before[2].lower()])
        k += 1
    return out


def _double(text: str, tokens: list[tuple[int, int, str]], n: int) -> int:
    """The last token of a name that goes on behind a hyphen."""
    while n + 1 < len(tokens) and text[tokens[n][1] : tokens[n + 1][0]] == "-":
        n += 1
    return n


_TAKEN = "one long, two long, kind string, start int, stop int, label string, terms array<string>, word long, n long"


def _take(given: set[str], family: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = [(k, c) for k, x in enumerate(texts) for c in candidates(x, given, family)]
            flat: list[str] = []
            for text in texts:
                low = text.lower() if text.isascii() else plain(text)[0].lower()
                w = _WORD.findall(low)
                flat += w
                flat += [f"{x} *" for x, y in zip(w, w[1:], strict=False) if y in _KINDS]
                if "." in low:
                    hosts = {*_HOST.findall(low), *_MAIL_HOST.findall(low)}
                    flat += [y for x in hosts for y in (x, "." + x.rpartition(".")[2]) for _ in range(low.count(x))]
            codes, unique = pd.factorize(np.asarray(flat, dtype=object))
            count = np.bincount(codes, minlength=len(unique)) if len(codes) else np.empty(0, np.int64)
            at = pa.array([k for k, _ in rows], pa.int64())
            pad = len(unique)
            padded = lambda x, kind, pad=pad: pa.concat_arrays([pa.array(x, kind), pa.nulls(pad, kind)])
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column("one").take(at), pa.nulls(pad, pa.int64())]),
                    pa.concat_arrays([batch.column("two").take(at), pa.nulls(pad, pa.int64())]),
                    *(padded([c[x] for _, c in rows], kind) for x, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())))),
                    pa.concat_arrays([none, pa.array(hash_words(unique).view(np.int64), pa.int64())]),
                    pa.concat_arrays([none, pa.array(count, pa.int64())]),
                ],
                [x.split()[0] for x in _TAKEN.split(", ")],
            )

    return run


@dataclass(frozen=True)
class Details:
    """details: grp, id, field, kind, start, stop, bits. terms: kind, term,
    bits: what the corpus says about each term."""

    details: DataFrame
    terms: DataFrame


def _hash_column(spark_terms: DataFrame) -> DataFrame:
    """word: the number that the words are counted under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bare = [x.partition(":")[2] for x in batch.column("term").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(hash_words(bare).view(np.int64), pa.int64())], ["term", "word"])

    return spark_terms.mapInArrow(run, "term string, word long")


def personal_details(texts: DataFrame, names: DataFrame, *, threshold: float = THRESHOLD) -> Details:
    """Personal details in the column text of ``texts`` (grp, id, field, text).

    ``names`` has name and name_kind (given, family); it needn't be complete.
    start and stop count the characters of the stored text from 0. (grp, id,
    field) identifies a text. Null and empty texts have no details. Details
    don't overlap: of overlapping ones, the first and then the longest stays.
    """
    # a list of names is a dictionary of a language: its size doesn't grow with the texts
    lists = {"given": set(), "family": set()}
    for x in names.select("name", "name_kind").distinct().toLocalIterator():
        if x.name and x.name_kind in lists:
            lists[x.name_kind].add(x.name.lower())
    # each text once: what recurs in copies of one text is no evidence
    named = {"one": F.xxhash64("text"), "two": F.xxhash64(F.lit(1), "text")}
    rows = texts.select(F.col("grp").cast("string"), F.col("id").cast("long"), F.col("field").cast("string"), "text").where("id is not null and text is not null")
    once = rows.select("text").distinct().withColumns(named)
    taken = materialise(once.mapInArrow(_take(lists["given"], lists["family"]), _TAKEN), "terms")
    found = taken.where("kind is not null")
    seen = found.withColumn("term", F.explode("terms"))

    # numbers: the odds that a term stands with a cue of the class
    numbers = seen.where("kind = 'number'").groupBy("term", "label").count()
    total = {x.label: x.n for x in found.where("kind = 'number'").groupBy("label").agg(F.count("*").alias("n")).collect()}  # three labels
    every = sum(total.values())

    def odds(label: str) -> DataFrame:
        own = total.get(label, 0)
        n = numbers.groupBy("term").agg(F.sum(F.when(F.col("label") == label, F.col("count")).otherwise(0)).alias("own"), F.sum("count").alias("all"))
        p = (own + 0.5) / (every + 1)
        told = (F.col("own") + PRIOR_WEIGHT * p) / (F.col("all") + PRIOR_WEIGHT)
        bits = F.log2(told / (1 - told)) - F.lit(float(np.log2(p / (1 - p))))
        return n.select(F.lit(label).alias("kind"), "term", bits.alias("bits"))

    # other terms: the share of their occurrences that stand in the protected form
    beside = seen.where("kind in ('name', 'address', 'email')").groupBy("kind", "term", "label").count()
    own, every_one = F.col("count"), F.sum("count")
    known = (
        F.when(F.col("term").startswith("street:"), own)
        .when(F.col("label") == "bare", own * BARE_ADDRESS)
        .when(F.col("label") != "", own)
        .otherwise(0)
    )
    share = beside.groupBy("kind", "term").agg(
        every_one.alias("held"),
        F.sum(known).alias("beside"),
        # any word may stand before a comma, and once after a letter: alone, that says nothing
        F.sum(F.when(F.col("label").startswith(","), 0).when(F.col("label").startswith("."), own / 2).otherwise(known)).alias("direct"),
        # entropy of the neighbours: a family name goes with many given names
        (F.log2(F.sum(known)) - F.sum(known * F.log2("count")) / F.sum(known)).alias("entropy"),
    )
    counts = taken.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    share = share.join(_hash_column(share.select("term").distinct()), "term").join(counts, "word", "left")
    listed = names.where("name_kind = 'family'").select(F.concat(F.lit("family:"), F.lower("name")).alias("term"), F.lit(True).alias("listed")).distinct()
    share = share.join(F.broadcast(listed), "term", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    needed = F.element_at(F.create_map(*(F.lit(x) for pair in REVEALS.items() for x in pair)), F.substring_index("term", ":", 1))
    assumed = F.when(F.col("listed"), ASSUMED_LISTED).otherwise(needed / 2)
    p = (F.col("beside") + PRIOR_WEIGHT * assumed) / (F.greatest("n", "held") + PRIOR_WEIGHT)
    varied = (F.col("kind") != "name") | F.col("listed") | ((F.col("entropy") >= F.least(F.lit(1.0), F.log2("beside") / 2)) & (F.col("direct") >= 1))
    shared = share.select("kind", "term", F.when(varied, F.log2(p / needed)).otherwise(F.lit(-20.0)).alias("bits"))
    terms = odds("phone").unionByName(odds("id_number")).unionByName(shared)

    key = ["one", "two", "start", "stop", "kind"]
    prior = {c: np.log2((total.get(c, 0) + 0.5) / (every - total.get(c, 0) + 0.5)) for c in ("phone", "id_number")}
    as_kind = F.when(F.col("kind") == "number", F.array(F.lit("phone"), F.lit("id_number"))).otherwise(F.array("kind"))
    scored = (
        # a top-level domain behind an @ says nothing more than the @
        seen.where("not (label = 'email' and term like 'tld:%')")
        .withColumn("kind", F.explode(as_kind))
        .join(terms, ["kind", "term"], "left")
        .groupBy(*key)
        .agg(F.sum("bits").alias("sum"), F.max("bits").alias("most"))
        .withColumn(
            "bits",
            F.when(F.col("kind") == "phone", F.col("sum") + F.lit(float(prior["phone"])))
            .when(F.col("kind") == "id_number", F.col("sum") + F.lit(float(prior["id_number"])))
            .otherwise(F.col("most")),
        )
        .where(F.col("bits") > threshold)
    )
    # the candidates of one text are few: they come from its own length
    best = scored.groupBy("one", "two").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("stop")).alias("till"), (-F.col("bits")).alias("less"), "kind"))).alias("all"))
    pick = lambda kept, x: F.when((F.size(kept) > 0) & (-F.element_at(kept, -1)["till"] > x["start"]), kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate("all", F.slice("all", 1, 0), pick)
    details = rows.select("grp", "id", "field", *(c.alias(k) for k, c in named.items())).join(best.select("one", "two", kept.alias("kept")), ["one", "two"])
    details = details.select("grp", "id", "field", F.explode("kept").alias("x")).select(
        "grp", "id", "field", F.col("x.kind").alias("kind"), F.col("x.start").alias("start"), (-F.col("x.till")).alias("stop"), (-F.col("x.less")).alias("bits")
    )
    return Details(materialise(details.distinct(), "details"), terms)


def sanitised(texts: DataFrame, details: DataFrame) -> DataFrame:
    """texts (grp, id, field, text) with a placeholder for every detail and
    all other characters as they were."""
    spans = details.groupBy("grp", "id", "field").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("spans"))
    names = F.create_map(*(F.lit(x) for pair in PLACEHOLDER.items() for x in pair))
    step = lambda s, x: F.struct(
        F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), names[x["kind"]]).alias("out"), x["stop"].alias("at")
    )
    done = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    rest = F.substring(F.col("text"), done["at"] + 1, F.length("text"))
    whole = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(done["out"], rest))
    return texts.select("grp", "id", "field", "text").join(spans, ["grp", "id", "field"], "left").select("grp", "id", "field", whole.alias("text"))

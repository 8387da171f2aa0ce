"""The same results in DuckDB's SQL, for the queries that SQL can express.

DuckDB's expressions know no look-around and only ASCII classes: letters,
digits and blanks are spelled out here.
"""

from __future__ import annotations

from tallyloom.functions.patterns import DOMAINS, ORDER, SLOT, SPECIAL, SPECIAL_OR_ALNUM, TOKEN, URL_WITH_DOMAIN
from tallyloom.functions.text import NA_TOKENS, TEXT_COLUMNS
from tallyloom.operators.prompts import COMMENT, HEADER, VIOLATION
from tallyloom.schemas import DATA2_SCORES, DATA3_SCORES

_BLANKS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_S, _NOT_S = f"[{_BLANKS}]", f"[^{_BLANKS}]"
_W, _NOT_W = r"[\pL\pN_]", r"[^\pL\pN_]"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _replace(column: str, *steps: tuple[str, str, str]) -> str:
    for pattern, replacement, flags in steps:
        column = f"regexp_replace({column}, {_text(pattern)}, {_text(replacement)}, '{flags}')"
    return column


def _normalised(expression: str) -> str:
    return f"SELECT src_pos, {expression} AS text FROM train"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is worked out once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


_STRIP = ((f"^{_S}+", "", "g"), (f"{_S}+$", "", "g"))
_STRIPPED = _replace("body", *_STRIP)

# The normalisers' patterns without look-around.
_CLOCK, _UTC = rf"\b[0-9]{{1,2}}:[0-9]{{1,2}},{_S}+", rf"{_S}+\(UTC\)"
_MONTH_DAY, _DAY_MONTH = rf"[A-Za-z]+{_S}+[0-9]{{1,2}},{_S}+[0-9]{{4}}", rf"[0-9]{{1,2}}{_S}+[A-Za-z]+{_S}+[0-9]{{4}}"
_PATTERNS: dict[str, tuple[tuple[str, str, str], ...]] = {
    "urls": ((rf"(?:(?:https?://|ftp://|www\.){_NOT_S}+)|(?:{_W}+{_S}*\.{_S}*(?:{DOMAINS})(?:{_S}|$|{_NOT_W}))", "<URL>", "gi"),),
    "usernames": ((rf"(^|{_NOT_W})/?u/[A-Za-z0-9_-]+", r"\1<USER>", "gi"), (rf"(^|{_NOT_W})@[A-Za-z0-9_]{{1,30}}\b", r"\1<USER>", "g")),
    "emails": ((r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "<EMAIL>", "gi"),),
    "subreddits": ((rf"(^|{_NOT_W})/?r/[A-Za-z0-9_-]+", r"\1<SUB>", "gi"),),
    "phones": ((rf"(?:\+?1[-.{_BLANKS}]?)?\(?[0-9]{{3}}\)?[-.{_BLANKS}]?[0-9]{{3}}[-.{_BLANKS}]?[0-9]{{4}}|1-800-[A-Z0-9-]+", "<PHONE>", "gi"),),
    "money": ((rf"[$£€][0-9]+(?:[,.][0-9]+)*(?:{_S}*(?:million|billion|k|M|B))?|(?:[0-9]+|[Xx]{{2,}}){_S}*(?:dollars?|pounds?|euros?)", "<MONEY>", "gi"),),
    "ips": ((r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "", "g"),),
    "timestamps": (
        *((x + _UTC, "", "g") for x in (_CLOCK + _MONTH_DAY, _CLOCK + _DAY_MONTH, rf"\b{_MONTH_DAY}", rf"\b{_DAY_MONTH}")),
        # forms with (UTC) are gone by now
        (rf"\b{_DAY_MONTH}($|{_NOT_W})", r"\1", "g"),
        (_CLOCK + _MONTH_DAY, "", "g"),
        (_CLOCK + _DAY_MONTH, "", "g"),
        (rf"\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{_S}+[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}[.0-9]*[+-][0-9]{{2}}:[0-9]{{2}}\b", "", "g"),
    ),
    "whitespace": ((r"[ \t]+", " ", "g"),),
}


def _random(text: str) -> str:
    """Codes. A match lies in one run of the characters that codes are made of,
    from the first place behind no word character on, to the end of the run."""
    alnum, letter, special = "[a-zA-Z0-9]", "[a-zA-Z]", SPECIAL
    end = SPECIAL_OR_ALNUM + "*"
    first = rf"{alnum}*[0-9]+{letter}+{special}{end}|{alnum}*{letter}+[0-9]+{special}{end}"
    loose = rf"{alnum}*{special}{alnum}*[0-9]{end}"
    # as loose, with a letter in it
    strict = rf"{alnum}*{letter}{alnum}*{special}{alnum}*[0-9]{end}|[0-9]*{special}{alnum}*{letter}{alnum}*[0-9]{end}|[0-9]*{special}[0-9]+{end}{letter}{end}"
    # where the run goes on with a letter of another script, a match ends before a sign
    sign = special.replace("_", "")
    found = lambda third, rest: f"regexp_replace(before || run, {_text(f'(^|{_NOT_W})(?:{first}|{third}){rest}')}, {_text(chr(92) + '1<RANDOM>' + (chr(92) + '2' if rest != '$' else ''))})"
    open_ended = rf"({sign}{end})$"
    replaced = (
        f"CASE WHEN NOT regexp_matches(run, {_text(f'^{SPECIAL_OR_ALNUM}')}) THEN run ELSE substr(CASE "
        f"WHEN regexp_matches(behind, '^{_W}') THEN CASE WHEN regexp_matches(behind, '{letter}') THEN {found(loose, open_ended)} ELSE {found(strict, open_ended)} END "
        f"WHEN regexp_matches(behind, '{letter}') THEN {found(loose, '$')} ELSE {found(strict, '$')} END, length(before) + 1) END"
    )
    runs = f"regexp_extract_all(word, {_text(SPECIAL_OR_ALNUM + '+|' + SPECIAL_OR_ALNUM.replace('[', '[^', 1) + '+')})"
    each = _let("runs[i]", "run", _let("coalesce(right(runs[i - 1], 1), '')", "before", _let("array_to_string(runs[i + 1:], '')", "behind", replaced)))
    word = _let(runs, "runs", f"array_to_string(list_transform(range(1, len(runs) + 1), lambda i: {each}), '')")
    words = f"regexp_extract_all(t, {_text(f'{_NOT_S}+|{_S}+')})"
    whole = f"array_to_string(list_transform({words}, lambda word: CASE WHEN regexp_matches(word, '^{_S}') THEN word ELSE {word} END), '')"
    return _let(text, "t", f"CASE WHEN t IS NOT NULL THEN {whole} END")


_LETTERS_TWICE = tuple((f"{c}{{3,}}", c * 2, "g") for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _characters(text: str) -> str:
    kept = f"list_filter(range(1, len(c) + 1), lambda i: i = 1 OR c[i] <> c[i - 1] OR regexp_matches(c[i], '^[a-zA-Z{_BLANKS}]$'))"
    once = _let("string_split(t, '')", "c", f"array_to_string(list_transform({kept}, lambda i: c[i]), '')")
    return _let(_replace(text, *_LETTERS_TWICE), "t", f"CASE WHEN t IS NOT NULL THEN {once} END")


def _words(text: str) -> str:
    """A word goes, with the blanks before it, if it is the one before them."""
    again = lambda i: f"(regexp_matches(w[{i}], '^{_W}') AND lower(w[{i}]) = lower(w[{i} - 2]) AND regexp_matches(w[{i} - 1], '^{_S}+$'))"
    kept = f"list_filter(range(1, len(w) + 1), lambda i: NOT coalesce({again('i')}, false) AND NOT coalesce({again('(i + 1)')}, false))"
    once = _let(f"regexp_extract_all(t, '{_W}+|{_NOT_W}+')", "w", f"array_to_string(list_transform({kept}, lambda i: w[i]), '')")
    return _let(text, "t", f"CASE WHEN t IS NOT NULL THEN {once} END")


def _quotes(text: str) -> str:
    bare = "CASE WHEN s = '\"' THEN '' WHEN left(s, 1) = '\"' AND right(s, 1) = '\"' THEN substr(s, 2, length(s) - 2) ELSE s END"
    return _let(_replace(text, *_STRIP), "s", bare)


def _step(name: str, text: str) -> str:
    own = {"random": _random, "characters": _characters, "words": _words, "quotes": _quotes}
    return own[name](text) if name in own else _replace(text, *_PATTERNS[name])


def _stages(table: str, columns: tuple[str, ...], names: tuple[str, ...] = ORDER) -> str:
    """``table`` with the steps applied to its columns, one after the other."""
    for name in names:
        table = f"(SELECT * REPLACE ({', '.join(f'{_step(name, c)} AS {c}' for c in columns)}) FROM {table})"
    return table


def _incremental(table: str) -> str:
    """src_pos, text: the pass over text that was normalised before."""
    shortened = f"(SELECT src_pos, body AS old, {_replace('body', (URL_WITH_DOMAIN.pattern, '<URL>', 'g'))} AS x FROM {table})"
    protected = f"(SELECT src_pos, old, regexp_extract_all(x, '{TOKEN}') AS tokens, regexp_replace(x, '{TOKEN}', '{SLOT}', 'g') AS body FROM {shortened})"
    split = f"(SELECT src_pos, old, tokens, string_split(body, '{SLOT}') AS parts FROM {_stages(protected, ('body',), ('random', 'characters', 'words', 'whitespace'))})"
    back = f"list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN i = 1 THEN parts[i] WHEN i - 1 <= len(tokens) THEN tokens[i - 1] || parts[i] ELSE '{SLOT}' || parts[i] END)"
    return f"SELECT src_pos, CASE WHEN length(new) > length(old) THEN old ELSE new END AS text FROM (SELECT src_pos, old, CASE WHEN old IS NOT NULL THEN array_to_string({back}, '') END AS new FROM {split})"


_STEP_QUERIES = {
    "norm_urls": "urls", "norm_usernames": "usernames", "norm_emails": "emails", "norm_subreddits": "subreddits", "norm_phones": "phones", "norm_money": "money",
    "norm_random": "random", "norm_ips": "ips", "norm_timestamps": "timestamps", "norm_quotes": "quotes", "reduce_characters": "characters", "reduce_words": "words",
    "reduce_whitespace": "whitespace",
}
_WHOLE_TEXT = f"SELECT src_pos, body AS text FROM {_stages('(SELECT src_pos, body FROM train)', ('body',))}"

ORACLE: dict[str, str] = {
    **{query: _normalised(_step(name, "body")) for query, name in _STEP_QUERIES.items()},
    "norm_text": _WHOLE_TEXT,
    "norm_text_exact": _WHOLE_TEXT,
    "norm_incremental": _incremental("train"),
    "norm_columns": f"SELECT src_pos, {', '.join(TEXT_COLUMNS)} FROM {_stages('test', TEXT_COLUMNS)}",
    "strip_text": _normalised(_STRIPPED),
    "sanitize": f"SELECT src_pos, s AS text FROM (SELECT src_pos, {_STRIPPED} AS s FROM train) WHERE s <> '' AND lower(s) NOT IN ('nan', 'none')",
    "na_tokens": f"SELECT src_pos, body FROM train WHERE body IS NULL OR body IN ({', '.join(map(_text, NA_TOKENS))})",
    "rule_labels": "SELECT substr(rule, 1, 50) || '...' AS label, 'Rule: ' || rule || chr(10) AS line, count(*) AS n_rows FROM train GROUP BY 1, 2",
    "violation_labels": "SELECT trim(rule) AS rule, CASE rule_violation WHEN 1 THEN 'positives' WHEN 0 THEN 'negatives' END AS polarity, count(*) AS n_rows "
    "FROM train GROUP BY 1, 2",
    "attach_labels": "SELECT d.doc_id, d.source, l.grade FROM documents d JOIN level_label l ON l.doc_id = d.doc_id WHERE l.grade <> -1",
    "fold_scores": "SELECT src_pos, CASE WHEN isnan(s) OR isnan(o) THEN NULL ELSE greatest(s, o) END AS severe_toxicity "
    "FROM (SELECT src_pos, severe_toxicity AS s, obscene AS o FROM data2_positive)",
    "csv_round_trip": "SELECT trim(rule) AS rule, count(*) AS n_rows, count(CASE WHEN body NOT IN ("
    + ", ".join(map(_text, NA_TOKENS))
    + ") THEN 1 END) AS n_bodies, sum(row_id)::bigint AS sum_row_id FROM test GROUP BY 1",
}

_UNION = " UNION ALL ".join(
    f"SELECT {n} AS dataset, '{side}s' AS polarity, src_pos, comment_text FROM data{n}_{side}" for n in (2, 3) for side in ("positive", "negative")
)
_ONCE = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, polarity, comment_text ORDER BY src_pos) AS k FROM ({_UNION})) WHERE k = 1"
_CLEAN = (
    f"SELECT o.dataset, o.polarity, o.src_pos, o.comment_text FROM ({_ONCE}) o WHERE o.dataset = 3 OR NOT EXISTS "
    f"(SELECT 1 FROM ({_ONCE}) t WHERE t.dataset = 3 AND t.comment_text IS NOT DISTINCT FROM o.comment_text)"
)
_SHUFFLED = "coalesce(md5('42:' || comment_text), '~')"
_SPLIT = (
    f"SELECT CASE WHEN row_number() OVER (PARTITION BY dataset, polarity ORDER BY {_SHUFFLED}, comment_text) <= "
    f"floor(count(*) OVER (PARTITION BY dataset, polarity) * 0.7::double) THEN 'train' ELSE 'holdout' END AS split, dataset, polarity, src_pos, comment_text FROM ({_CLEAN})"
)
_SCORE_RULES = ", ".join(map(_text, dict.fromkeys((*DATA2_SCORES, *DATA3_SCORES))))
_SCORED = " UNION ALL ".join(
    f"SELECT '{c}' AS rule_key, {n} AS dataset, src_pos, comment_text AS text FROM data{n}_positive WHERE {c} >= 0.33 AND NOT isnan({c})"
    for n, scores in ((2, DATA2_SCORES), (3, DATA3_SCORES))
    for c in scores
)
_ITEMS = (
    f"SELECT rule_key || '/positives' AS pool_id, row_number() OVER (PARTITION BY rule_key ORDER BY dataset, src_pos) - 1 AS pos, text FROM ({_SCORED}) UNION ALL "
    f"SELECT 'shared/negatives', row_number() OVER (ORDER BY dataset, src_pos) - 1, comment_text FROM ({_UNION}) WHERE polarity = 'negatives'"
)


def _examples(table: str, body: bool, collision: str = "last") -> str:
    parts = [
        f"SELECT rule AS spelling, trim(rule) AS rule, '{p}s' AS polarity, {n} AS src_no, src_pos, {p}_example_{n} AS text FROM {table} WHERE rule IS NOT NULL"
        for p in ("positive", "negative")
        for n in (1, 2)
    ]
    if body:
        parts += [
            f"SELECT rule, trim(rule), '{p}', 3, src_pos, body FROM {table} WHERE rule IS NOT NULL AND rule_violation = {v}"
            for p, v in (("positives", 1), ("negatives", 0))
        ]
    rows = " UNION ALL ".join(parts)
    if collision == "last":
        seen = f"SELECT rule AS spelling, min(src_pos) AS seen FROM {table} WHERE rule IS NOT NULL GROUP BY 1"
        last = f"SELECT spelling FROM (SELECT spelling, row_number() OVER (PARTITION BY trim(spelling) ORDER BY seen DESC) AS k FROM ({seen})) WHERE k = 1"
        rows = f"SELECT * FROM ({rows}) WHERE spelling IN ({last})"
    return rows


def _grouped(table: str, body: bool, collision: str = "last") -> str:
    first = (
        "SELECT rule, polarity, src_no, src_pos, text FROM (SELECT *, row_number() OVER (PARTITION BY rule, polarity, text ORDER BY src_no, src_pos) AS k "
        f"FROM ({_examples(table, body, collision)})) WHERE k = 1"
    )
    return f"SELECT rule, polarity, row_number() OVER (PARTITION BY rule, polarity ORDER BY src_no, src_pos) - 1 AS pos, text FROM ({first})"


def _split_pools(pools: str, columns: str = "split, rule, polarity, text") -> str:
    order = "coalesce(md5('42:' || rule || ':' || polarity || ':' || text), '~'), text"
    place = f"row_number() OVER (PARTITION BY rule, polarity ORDER BY {order}) <= floor(count(*) OVER (PARTITION BY rule, polarity) * 0.7::double)"
    return f"SELECT {columns} FROM (SELECT *, CASE WHEN {place} THEN 'train' ELSE 'holdout' END AS split FROM ({pools}))"


def _score_pools(rows: str) -> str:
    """rule, polarity, pos, text of the score rules over rows with the scores."""
    scored = " UNION ALL ".join(
        f"SELECT '{c}' AS rule_key, r.dataset, r.src_pos, r.comment_text AS text, r.split FROM ({rows}) r JOIN data{n}_positive d ON d.src_pos = r.src_pos "
        f"WHERE r.dataset = {n} AND r.polarity = 'positives' AND d.{c} >= 0.33 AND NOT isnan(d.{c})"
        for n, scores in ((2, DATA2_SCORES), (3, DATA3_SCORES))
        for c in scores
    )
    return (
        "SELECT s.split, d.rule, 'positives' AS polarity, row_number() OVER (PARTITION BY s.split, d.rule_key ORDER BY s.dataset, s.src_pos) - 1 AS pos, s.text "
        f"FROM ({scored}) s JOIN rule_def d ON d.rule_key = s.rule_key UNION ALL "
        "SELECT split, '*scores', 'negatives', row_number() OVER (PARTITION BY split ORDER BY dataset, src_pos) - 1, comment_text "
        f"FROM ({rows}) WHERE polarity = 'negatives'"
    )


def _negatives_report(pools: str) -> str:
    return (
        f"WITH p AS ({pools}), e AS (SELECT text, count(DISTINCT rule) AS n FROM p WHERE polarity = 'negatives' GROUP BY text), "
        "r AS (SELECT count(DISTINCT rule) AS n FROM p) SELECT (SELECT n FROM r) <= 1 OR count(*) = 0 OR min(n) = (SELECT n FROM r) AS fully_shared, "
        "(SELECT n FROM r) <= 1 OR max(n) = (SELECT n FROM r) AS partially_shared, count(*) AS total_unique, (SELECT n FROM r) AS n_rules FROM e"
    )


_TRAIN = _grouped("train", True)
_PLAIN = _grouped("train", False)
_WHOLE = _score_pools(f"SELECT *, 'all' AS split FROM ({_UNION})")

def _choice(n: str, *parts: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 12))::bigint % {n})"


def _supported(table: str = "test") -> str:
    draws = (
        "SELECT t.*, v.variant, CASE WHEN v.variant = 0 THEN 'positives' ELSE 'negatives' END AS polarity, row_number() OVER (PARTITION BY trim(t.rule), v.variant "
        f"ORDER BY t.src_pos) - 1 AS draw FROM {table} t, (SELECT unnest([0, 1])::int AS variant) v"
    )
    return (
        f"WITH pool AS ({_grouped(table, False)}), sizes AS (SELECT rule, polarity, count(*) AS n FROM pool GROUP BY 1, 2) "
        "SELECT d.*, CASE d.polarity WHEN 'positives' THEN 1 ELSE 0 END AS support_label, p.pos AS support_pos, p.text AS support "
        f"FROM ({draws}) d LEFT JOIN sizes s ON s.rule = trim(d.rule) AND s.polarity = d.polarity "
        "LEFT JOIN pool p ON p.rule = s.rule AND p.polarity = s.polarity AND p.pos = d.draw % s.n"
    )


def _reshuffled(rows: str, pool: str, order: str, seed: int) -> str:
    """``rows`` (a rule named r, polarity) with the item that each gets if every
    round through a pool has an order of its own."""
    return (
        f"WITH pool AS ({pool}), sizes AS (SELECT rule, polarity, count(*) AS n FROM pool GROUP BY 1, 2), "
        f"drawn AS (SELECT *, row_number() OVER (PARTITION BY r, polarity ORDER BY {order}) - 1 AS draw FROM ({rows})), "
        "sized AS (SELECT d.*, d.draw // s.n AS epoch, d.draw % s.n AS place FROM drawn d LEFT JOIN sizes s ON s.rule = d.r AND s.polarity = d.polarity), "
        "rounds AS (SELECT DISTINCT r, polarity, epoch FROM sized WHERE epoch IS NOT NULL), "
        "placed AS (SELECT e.r, e.polarity, e.epoch, p.pos, p.text, row_number() OVER (PARTITION BY e.r, e.polarity, e.epoch "
        f"ORDER BY md5(concat_ws(':', '{seed}', e.r, e.polarity, e.epoch, p.pos)), p.pos) - 1 AS place "
        "FROM rounds e JOIN pool p ON p.rule = e.r AND p.polarity = e.polarity) "
        "SELECT z.*, p.pos AS support_pos, p.text AS support FROM sized z LEFT JOIN placed p ON p.r = z.r AND p.polarity = z.polarity AND p.epoch = z.epoch AND p.place = z.place"
    )


def _side(label: str) -> str:
    return f"CASE {label} WHEN 1 THEN 'positives' ELSE 'negatives' END"


def _samples(n: int) -> str:
    """An epoch's samples from the pools of the training table, split."""
    split = f"SELECT split, rule, polarity, text, row_number() OVER (PARTITION BY split, rule, polarity ORDER BY text NULLS FIRST) - 1 AS pos FROM ({_split_pools(_TRAIN)})"
    drawn = (
        f"SELECT i AS sample_id, {_choice('(SELECT count(*) FROM rules)', _text('rule'), 'i')} AS rule_no, {_choice('2', _text('train'), 'i')}::int AS label_train, "
        f"{_choice('2', _text('test'), 'i')}::int AS label_test FROM (SELECT unnest(range({n})) AS i)"
    )
    ruled = f"SELECT s.sample_id, s.label_train, s.label_test, u.rule AS r, {_side('s.label_train')} AS polarity FROM ({drawn}) s JOIN rules u ON u.rule_no = s.rule_no"
    order = "md5(concat_ws(':', '42', 'holdout', rule, polarity, pos)), pos"
    held = f"SELECT rule, polarity, text, row_number() OVER (PARTITION BY rule, polarity ORDER BY {order}) - 1 AS pos FROM split WHERE split = 'holdout'"
    forms = "[rule, lower(rule), upper(rule), 'Please note: ' || rule, rule || '!']"
    return (
        f"WITH split AS ({split}), rules AS (SELECT rule, row_number() OVER (ORDER BY rule) - 1 AS rule_no FROM (SELECT DISTINCT rule FROM split WHERE split = 'train')), "
        f"one AS ({_reshuffled(ruled, 'SELECT rule, polarity, pos, text FROM split WHERE split = ' + _text('train'), 'sample_id', 42)}), "
        f"held AS ({held}), held_sizes AS (SELECT rule, polarity, count(*) AS n FROM held GROUP BY 1, 2), "
        f"two AS (SELECT sample_id, r, label_train, label_test, support, {_side('label_test')} AS polarity, row_number() OVER (PARTITION BY r, label_test ORDER BY sample_id) - 1 AS draw FROM one), "
        f"variants AS (SELECT rule, {forms} AS forms FROM (SELECT DISTINCT trim(rule) AS rule FROM train WHERE rule IS NOT NULL)) "
        "SELECT t.sample_id, t.r AS rule, t.label_train, t.label_test, h.pos AS idx, "
        f"coalesce(v.forms[{_choice('coalesce(len(v.forms), 1)', _text('variant'), 't.sample_id')} + 1], t.r) AS rule_text, t.support, h.text AS target "
        "FROM two t LEFT JOIN held_sizes s ON s.rule = t.r AND s.polarity = t.polarity LEFT JOIN held h ON h.rule = s.rule AND h.polarity = s.polarity AND h.pos = t.draw % s.n "
        "LEFT JOIN variants v ON v.rule = t.r"
    )


_SUPPORTED = _supported()
_FLIPPED = (
    f"SELECT t.src_pos, t.row_id, trim(t.rule) AS r, v.variant, CASE WHEN v.variant = {_choice('2', 't.row_id', 't.src_pos', seed=7)} THEN 'positives' ELSE 'negatives' END AS polarity "
    "FROM test t, (SELECT unnest([0, 1])::int AS variant) v"
)
_ANSWER = "CASE support_label WHEN 1 THEN 'Violation: Yes' ELSE 'Violation: No' END || chr(10)"
_BEFORE = f"{_text(HEADER[:-1])} || chr(10) || 'Rule: ' || rule || chr(10) || '{COMMENT}' || support || chr(10)"
_PROMPT = f"{_BEFORE} || {_ANSWER} || '{COMMENT}' || body || chr(10) || '{VIOLATION}'"

ORACLE |= {
    "toxicity_scan": f"SELECT dataset, polarity, count(*) AS n_rows, count(comment_text) AS n_texts FROM ({_UNION}) GROUP BY 1, 2",
    "polarity_by_score": "SELECT CASE WHEN "
    + " OR ".join(f"coalesce({c} > 0.33 AND NOT isnan({c}), false)" for c in DATA2_SCORES)
    + " THEN 'positives' ELSE 'negatives' END AS polarity, count(*) AS n_rows FROM (SELECT * FROM data2_positive UNION ALL SELECT * FROM data2_negative) GROUP BY 1",
    "dedup_keep_first": f"SELECT dataset, polarity, src_pos, comment_text FROM ({_ONCE})",
    "cross_dedup_anti": _CLEAN,
    "split_train_holdout": f"SELECT split, dataset, polarity, src_pos FROM ({_SPLIT})",
    "half_split": "SELECT src_pos, CASE WHEN row_number() OVER (ORDER BY md5('42:' || src_pos), src_pos) <= count(*) OVER () // 2 THEN 0 ELSE 1 END AS worker FROM test",
    "threshold_scores": _SCORED,
    "rule_fanout": _ITEMS,
    "rule_pool_refs": "SELECT d.rule_key, d.rule, p.polarity, p.pool_id, coalesce(n.n, 0) AS n_items FROM rule_def d, "
    "LATERAL (SELECT 'positives' AS polarity, d.rule_key || '/positives' AS pool_id UNION ALL SELECT 'negatives', 'shared/negatives') p "
    f"LEFT JOIN (SELECT pool_id, count(*) AS n FROM ({_ITEMS}) GROUP BY 1) n ON n.pool_id = p.pool_id "
    f"WHERE d.rule_key IN ({_SCORE_RULES})",
    "group_by_rule": _TRAIN,
    "group_by_rule_merged": _grouped("train", False, "merge"),
    "grouped_split": _split_pools(_TRAIN),
    "split_first_pools": _score_pools(_SPLIT),
    "build_pools": f"WITH own AS ({_split_pools(_TRAIN)}), scores AS ({_score_pools(_SPLIT)}) SELECT split, rule, polarity, count(*) AS n_items FROM "
    "(SELECT split, rule, polarity FROM own WHERE rule NOT IN (SELECT rule FROM scores) UNION ALL SELECT split, rule, polarity FROM scores) GROUP BY 1, 2, 3",
    "pools_round_trip": f"SELECT rule, polarity, count(*) AS n_items FROM ({_split_pools(_PLAIN)}) WHERE split = 'holdout' GROUP BY 1, 2",
    "group_first_pools": _split_pools(
        f"SELECT rule, polarity, text FROM ({_WHOLE}) WHERE polarity = 'positives' UNION ALL "
        f"SELECT DISTINCT rule, polarity, text FROM ({_WHOLE}) WHERE polarity = 'negatives' AND text <> ''"
    ),
    "combine_rules": f"WITH two AS ({_grouped('test', False)}) SELECT * FROM ({_PLAIN}) WHERE rule NOT IN (SELECT rule FROM two) UNION ALL SELECT * FROM two",
    "pool_stats": f"SELECT rule, count(*) FILTER (polarity = 'positives') AS n_positives, count(*) FILTER (polarity = 'negatives') AS n_negatives, "
    f"count(DISTINCT CASE polarity WHEN 'negatives' THEN text END) AS n_unique_negatives FROM ({_TRAIN}) GROUP BY ROLLUP (rule)",
    "shared_negatives": _negatives_report(_PLAIN),
    "shared_negatives_of_scores": _negatives_report(
        f"SELECT d.rule, 'positives' AS polarity, s.text FROM ({_SCORED}) s JOIN rule_def d ON d.rule_key = s.rule_key UNION ALL "
        f"SELECT d.rule, 'negatives', u.comment_text FROM rule_def d, ({_UNION}) u WHERE u.polarity = 'negatives' AND d.rule_key IN ({_SCORE_RULES})"
    ),
    "unique_negatives": f"SELECT rule, count(DISTINCT text) + max((text IS NULL)::int) AS unique_count FROM ({_PLAIN}) WHERE polarity = 'negatives' GROUP BY 1",
    "own_negatives": f"SELECT DISTINCT rule, polarity, rule || '/' || polarity AS pool_id FROM ({_PLAIN})",
    "toxicity_csv": f"SELECT dataset, polarity, count(*) AS n_rows, count(CASE WHEN comment_text NOT IN ({', '.join(map(_text, NA_TOKENS))}) THEN 1 END) AS n_texts, "
    "count(CASE WHEN s >= 0.33 AND NOT isnan(s) THEN 1 END) AS n_severe FROM ("
    + " UNION ALL ".join(
        f"SELECT {n} AS dataset, '{side}s' AS polarity, comment_text, severe_toxicity AS s FROM data{n}_{side}" for n in (2, 3) for side in ("positive", "negative")
    )
    + ") GROUP BY 1, 2",
    "stream_violations": "SELECT strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, trim(rule) AS rule, count(*) AS n_comments, count(*) FILTER (rule_violation = 1) AS n_violations "
    "FROM train WHERE created_at IS NOT NULL GROUP BY 1, 2",
    "clean_negatives": f"SELECT DISTINCT text FROM ({_PLAIN}) WHERE polarity = 'negatives' AND text <> ''",
    "expand_rows": "SELECT src_pos, row_id, variant, CASE variant WHEN 0 THEN 'positives' ELSE 'negatives' END AS polarity "
    "FROM test, (SELECT unnest([0, 1])::int AS variant)",
    "support_sampler": f"SELECT src_pos, row_id, variant, support_label, support_pos, support FROM ({_SUPPORTED})",
    "support_sampler_reshuffled": "SELECT src_pos, row_id, variant, CASE polarity WHEN 'positives' THEN 1 ELSE 0 END AS support_label, support_pos "
    f"FROM ({_reshuffled(_FLIPPED, _grouped('test', False), 'src_pos, variant', 7)})",
    "training_samples": _samples(2000),
    "score_comments": f"WITH clean AS (SELECT * FROM {_stages('test', TEXT_COLUMNS)}), sized AS (SELECT row_id, variant, coalesce(length({_PROMPT}), 0) AS n FROM ({_supported('clean')})) "
    "SELECT row_id, round(avg((n % 97) / 100.0::double) - avg(n / 1000.0::double), 6) AS rule_violation FROM sized GROUP BY row_id",
    "prompt_build": f"SELECT row_id, src_pos, variant, support_label, {_PROMPT} AS prompt FROM ({_SUPPORTED})",
    "violation_positions": f"SELECT src_pos, variant, strlen({_BEFORE} || '{VIOLATION}') - 1 AS first_end, strlen({_PROMPT}) - 1 AS second_end FROM ({_SUPPORTED})",
}

_LOGITS = (
    "WITH e AS (SELECT vec_id, label, unnest(embedding)::double AS x, unnest(range(len(embedding))) AS i FROM embeddings), "
    "h AS (SELECT e.label AS class_id, e.i, e.x FROM e WHERE vec_id IN (SELECT min(vec_id) FROM embeddings WHERE label < 2 GROUP BY label)), "
    "flat AS (SELECT e.vec_id, h.class_id, sum(e.x * h.x) AS logit FROM e JOIN h ON h.i = e.i GROUP BY 1, 2), "
    "logits AS (SELECT vec_id // 2 AS row_id, (vec_id % 2)::int AS variant, sum(logit) FILTER (class_id = 0) AS logit_no, sum(logit) FILTER (class_id = 1) AS logit_yes "
    "FROM flat GROUP BY vec_id), "
    "scores AS (SELECT row_id, avg(logit_yes) - avg(logit_no) AS margin FROM logits GROUP BY row_id), "
    "truth AS (SELECT vec_id // 2 AS row_id, (label > 4)::int AS label FROM embeddings WHERE vec_id % 2 = 0), "
    "known AS (SELECT t.row_id, t.label, round(s.margin, 2) + 0.0 AS score FROM truth t LEFT JOIN scores s ON s.row_id = t.row_id), "
    "loss AS (SELECT *, greatest(logit_no, logit_yes) + ln(1 + exp(-abs(logit_yes - logit_no))) - 0.9 * CASE variant WHEN 1 THEN logit_yes ELSE logit_no END "
    "- 0.05 * (logit_no + logit_yes) AS loss FROM logits) "
)

ORACLE |= {
    "mean_embedding": "SELECT i AS dim, round(avg(x), 6) AS mean FROM (SELECT unnest(embedding)::double AS x, unnest(range(len(embedding)))::int AS i FROM embeddings) GROUP BY i",
    "head_round_trip": _LOGITS + "SELECT vec_id, class_id, round(logit, 5) AS logit FROM flat",
    "linear_head": _LOGITS + "SELECT vec_id, class_id, round(logit, 5) AS logit FROM flat",
    "logit_bags": _LOGITS + "SELECT row_id, count(*) AS n_variants, round(max_by(logit_yes, variant), 5) AS last_yes FROM logits GROUP BY row_id",
    "margin_by_row": _LOGITS + "SELECT row_id, round(margin, 5) AS rule_violation FROM scores",
    "best_margin_by_row": _LOGITS + "SELECT row_id, round(max(logit_yes - logit_no), 5) AS rule_violation FROM logits GROUP BY row_id",
    "submission": _LOGITS + "SELECT row_id, round(margin, 5) AS rule_violation FROM scores",
    # the two halves have no row in common: all rows, each once
    "merge_predictions": _LOGITS + "SELECT row_id, variant, round(logit_yes, 5) AS logit_yes FROM logits",
    "eval_join": _LOGITS + "SELECT row_id, label, score FROM known",
    "roc_auc": _LOGITS + ", ranked AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM known WHERE score IS NOT NULL) "
    "SELECT round(((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / "
    "(count(*) FILTER (label = 1) * count(*) FILTER (label = 0)))::double, 8) AS auc FROM ranked",
    "ce_loss": _LOGITS + "SELECT row_id, variant, round(loss, 5) AS loss FROM loss",
    "epoch_loss": _LOGITS + "SELECT row_id % 10 AS epoch, round(avg(loss) FILTER (variant = 0), 5) AS train_loss, round(avg(loss) FILTER (variant = 1), 5) AS val_loss "
    "FROM loss GROUP BY 1",
}

_BYTES = "SELECT src_pos, unnest(range(1, strlen(s) + 1)) AS i, hex(encode(s)) AS h FROM (SELECT src_pos, {strip} AS s FROM {table}) WHERE s <> '' AND lower(s) NOT IN ('nan', 'none')"


def _bytes(table: str, column: str) -> str:
    rows = _BYTES.format(strip=_replace(column, *_STRIP), table=table)
    return f"SELECT src_pos, i, ('0x' || substr(h, 2 * i - 1, 2))::int AS id FROM ({rows})"


_SAMPLE_BEFORE = f"{_text(HEADER[:-1])} || chr(10) || 'Rule: ' || rule_text || chr(10) || '{COMMENT}' || support || chr(10)"
_SAMPLE_BEHIND = f"CASE label_train WHEN 1 THEN 'Violation: Yes' ELSE 'Violation: No' END || chr(10) || '{COMMENT}' || target || chr(10) || '{VIOLATION}'"
_FRAGMENTS = (
    "SELECT fragment, NULL AS rule, NULL::int AS variant_no, p FROM (VALUES "
    f"('header', {_text(HEADER[:-1])} || chr(10)), ('comment', '{COMMENT}'), ('line_end', chr(10)), ('violation_yes', 'Violation: Yes' || chr(10)), "
    f"('violation_no', 'Violation: No' || chr(10)), ('violation', '{VIOLATION}')) AS f(fragment, p) UNION ALL "
    "SELECT 'rule', rule, (row_number() OVER (PARTITION BY rule ORDER BY no) - 1)::int, 'Rule: ' || text || chr(10) FROM (SELECT rule, text, min(no) AS no FROM "
    "(SELECT rule, unnest([rule, lower(rule), upper(rule), 'Please note: ' || rule, rule || '!']) AS text, unnest(range(5)) AS no FROM "
    "(SELECT DISTINCT trim(rule) AS rule FROM train WHERE rule IS NOT NULL)) GROUP BY 1, 2)"
)
_PROMPT_BYTES = f"SELECT src_pos, variant, unnest(range(1, strlen(p) + 1)) AS i, hex(encode(p)) AS h FROM (SELECT src_pos, variant, {_PROMPT} AS p FROM ({_SUPPORTED})) WHERE p IS NOT NULL"

ORACLE |= {
    "embedding_gather": f"WITH v AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM (SELECT DISTINCT id FROM ({_bytes('train', 'body')}))) "
    "SELECT v.new_id, len(e.embedding) AS dims, round((SELECT sum(x::double) FROM unnest(e.embedding) AS u(x)), 5) AS total FROM v JOIN embeddings e ON e.vec_id = v.id",
    "token_vocab": f"SELECT DISTINCT id AS old_id FROM ({_bytes('train', 'body')})",
    "vocab_map": f"SELECT old_id, row_number() OVER (ORDER BY old_id) - 1 AS new_id FROM (SELECT DISTINCT id AS old_id FROM ({_bytes('train', 'body')}))",
    "vocab_remap": f"WITH v AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM (SELECT DISTINCT id FROM ({_bytes('data2_positive', 'comment_text')}))) "
    f"SELECT b.src_pos, count(*) AS n_ids, sum(coalesce(v.new_id, (SELECT count(*) FROM v)) * b.i)::bigint AS weighed FROM ({_bytes('train', 'body')}) b "
    "LEFT JOIN v ON v.id = b.id GROUP BY b.src_pos",
    "prompt_tokens": f"SELECT src_pos, variant, count(*) AS n_ids, sum(('0x' || substr(h, 2 * i - 1, 2))::bigint * i)::bigint AS weighed FROM ({_PROMPT_BYTES}) GROUP BY 1, 2",
    "training_sample_ids": f"SELECT sample_id, label_train, label_test, count(*) AS n_ids, sum(('0x' || substr(h, 2 * i - 1, 2))::bigint * i)::bigint AS weighed, "
    "any_value(first_end) AS first_end, any_value(second_end) AS second_end FROM (SELECT *, unnest(range(1, strlen(p) + 1)) AS i, hex(encode(p)) AS h FROM "
    f"(SELECT sample_id, label_train, label_test, {_SAMPLE_BEFORE} || {_SAMPLE_BEHIND} AS p, strlen({_SAMPLE_BEFORE} || '{VIOLATION}') - 1 AS first_end, "
    f"strlen({_SAMPLE_BEFORE} || {_SAMPLE_BEHIND}) - 1 AS second_end FROM ({_samples(2000)})) WHERE p IS NOT NULL) GROUP BY 1, 2, 3 UNION ALL "
    f"SELECT sample_id, label_train, label_test, NULL, NULL, CASE WHEN support IS NOT NULL THEN strlen({_SAMPLE_BEFORE} || '{VIOLATION}') - 1 END, NULL "
    f"FROM ({_samples(2000)}) WHERE support IS NULL OR target IS NULL",
    "prompt_fragments": "SELECT fragment, rule, variant_no, count(*) AS n_ids, sum(('0x' || substr(h, 2 * i - 1, 2))::bigint * i)::bigint AS weighed FROM "
    f"(SELECT fragment, rule, variant_no, unnest(range(1, strlen(p) + 1)) AS i, hex(encode(p)) AS h FROM ({_FRAGMENTS})) GROUP BY 1, 2, 3",
    "tokens_round_trip": "SELECT pool_id, count(*) AS n_items, sum(strlen(s))::bigint AS n_ids, count(*) - 1 AS last_pos "
    f"FROM (SELECT pool_id, {_replace('text', *_STRIP)} AS s FROM ({_ITEMS})) WHERE s <> '' AND lower(s) NOT IN ('nan', 'none') GROUP BY 1",
    "tokenize_pools": f"SELECT pool_id, row_number() OVER (PARTITION BY pool_id ORDER BY pos) - 1 AS pos, strlen(s) AS n_ids "
    f"FROM (SELECT pool_id, pos, {_replace('text', *_STRIP)} AS s FROM ({_ITEMS})) WHERE s <> '' AND lower(s) NOT IN ('nan', 'none')",
}

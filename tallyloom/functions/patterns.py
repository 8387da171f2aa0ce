"""Patterns of the text normalisers, in a spelling that Java and Python share.

Word characters, blanks and case are Unicode's: Java gets that by flags.
A word boundary next to a word character is written as a look-around, which
costs Java less.
"""

from __future__ import annotations

from typing import NamedTuple


class Step(NamedTuple):
    pattern: str
    replacement: str
    ignore_case: bool = False


# What the normalisers look for and what they put in its place.
DOMAINS = "com|org|net|edu|gov|co\\.uk|io|ly|me|tv|info|biz|us|ca"
SPECIAL = "[!@#$%^&*()_+\\-=\\[\\]{}|;':\",.<>?~`]"
SPECIAL_OR_ALNUM = "[a-zA-Z0-9!@#$%^&*()_+\\-=\\[\\]{}|;':\",.<>?~`]"
CLOCK = r"(?<!\w)[0-9]{1,2}:[0-9]{1,2},\s+"
MONTH_DAY = r"[A-Za-z]+\s+[0-9]{1,2},\s+[0-9]{4}"
DAY_MONTH = r"[0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4}"
UTC = r"\s+\(UTC\)"

URL = Step(rf"(?:(?:https?://|ftp://|www\.)[^\s]+)|(?:(?<!\w)\w++\s*\.\s*(?:{DOMAINS})(?:\s|$|[^\w]))", "<URL>", True)
MENTION = Step(r"(?<!\w)/?u/[A-Za-z0-9_-]+", "<USER>", True)
AT_MENTION = Step(r"(?<!\w)@[A-Za-z0-9_]{1,30}(?!\w)", "<USER>")
EMAIL = Step(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?!\w)", "<EMAIL>", True)
SUBREDDIT = Step(r"(?<!\w)/?r/[A-Za-z0-9_-]+", "<SUB>", True)
PHONE = Step(r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}|1-800-[A-Z0-9-]+", "<PHONE>", True)
MONEY = Step(
    r"[\$£€][0-9]+(?:[,.][0-9]+)*+(?:\s*(?:million|billion|k|M|B))?|(?:[0-9]+|[Xx]{2,})\s*(?:dollars?|pounds?|euros?)", "<MONEY>", True
)
RANDOM = Step(
    rf"(?<!\w)(?=\S*[0-9])(?=\S*[a-zA-Z])(?=\S*{SPECIAL})(?:[a-zA-Z0-9]*[0-9]+[a-zA-Z]+{SPECIAL}{SPECIAL_OR_ALNUM}*"
    rf"|[a-zA-Z0-9]*[a-zA-Z]+[0-9]+{SPECIAL}{SPECIAL_OR_ALNUM}*|[a-zA-Z0-9]*{SPECIAL}[a-zA-Z0-9]*[0-9]{SPECIAL_OR_ALNUM}*)(?!\w)",
    "<RANDOM>",
    True,
)
IP_ADDRESS = Step(r"(?<!\w)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w)", "")
TIMESTAMPS = (
    Step(CLOCK + MONTH_DAY + UTC, ""),
    Step(CLOCK + DAY_MONTH + UTC, ""),
    Step(r"(?<!\w)" + MONTH_DAY + UTC, ""),
    Step(r"(?<!\w)" + DAY_MONTH + UTC, ""),
    Step(r"(?<!\w)" + DAY_MONTH + rf"(?!{UTC}|\w)", ""),
    Step(CLOCK + MONTH_DAY + rf"(?!{UTC})", ""),
    Step(CLOCK + DAY_MONTH + rf"(?!{UTC})", ""),
    Step(r"(?<!\w)[0-9]{4}-[0-9]{2}-[0-9]{2}\s+[0-9]{2}:[0-9]{2}:[0-9]{2}[.0-9]*[+-][0-9]{2}:[0-9]{2}(?!\w)", ""),
)
OUTER_BLANKS = Step(r"\A[\s\x1c-\x1f]+|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++\Z", "")
OUTER_QUOTES = Step(r"\A(?:\"\Z|\"([\s\S]*)\"\Z)", "$1")
LETTERS = Step(r"([a-zA-Z])\1{2,}", "$1$1")
NON_LETTERS = Step(r"([^a-zA-Z\s])\1+", "$1")
REPEATED = r"\b(\w+)(\s+\1){1,}\b"
# The same for Java: possessive, so that thousands of repeats don't exhaust the stack.
WORDS = Step(r"(?<!\w)(\w+)(?:\s+\1(?!\w))++", "$1", True)
BLANKS = Step(r"[ \t]+", " ")

# Fixed values of the incremental pass over text that was normalised before.
URL_WITH_DOMAIN = Step(r"<URL_[^>]+>", "<URL>")
TOKEN = r"<(USER|EMAIL|SUB|PHONE|MONEY|URL|RANDOM)>"
SLOT = "TOKENPLACEHOLDER"
INCREMENTAL = (RANDOM, LETTERS, NON_LETTERS, WORDS, BLANKS)

STEPS: dict[str, tuple[Step, ...]] = {
    "urls": (URL,),
    "usernames": (MENTION, AT_MENTION),
    "emails": (EMAIL,),
    "subreddits": (SUBREDDIT,),
    "phones": (PHONE,),
    "money": (MONEY,),
    "random": (RANDOM,),
    "ips": (IP_ADDRESS,),
    "timestamps": TIMESTAMPS,
    "quotes": (OUTER_BLANKS, OUTER_QUOTES),
    "characters": (LETTERS, NON_LETTERS),
    "words": (WORDS,),
    "whitespace": (BLANKS,),
}
#: What a text holds if a step can find anything in it, in a form that is found
#: fast: most texts hold none of it and are left alone.
NEEDS: dict[str, str] = {
    "urls": rf"(?iuU)\.[\s\x1c-\x1f]*+(?:{DOMAINS})|://|www\.",
    "usernames": "[uU]/|@",
    "emails": "@",
    "subreddits": "[rR]/",
    "phones": "[0-9]{3}",
    "money": "(?iu)[$£€]|dollar|pound|euro",
    "random": "[0-9]",
    "ips": r"[0-9]\.[0-9]",
    "timestamps": "[0-9]{4}",
}
#: The whole normaliser, in its order; mentions of subreddits stay.
ORDER = ("urls", "usernames", "emails", "phones", "money", "random", "ips", "timestamps", "quotes", "characters", "words", "whitespace")

"""Text functions: tokens, hashes, sanitising, redaction, citations. All are Catalyst expressions but the card mask."""

from __future__ import annotations

import hashlib
from pyspark.sql import Column, functions as F

# fixed values: patterns that results depend on
WORD = r"[\p{L}\d_]+"
BOW_TOKEN = r"[a-z0-9][a-z0-9\-]+"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z\d])"
SUBCHUNK_GAP = r"(?<=[.!?])\s+"
SOURCE_MARK = r"\[Source (\d+)\]"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b(?:\d[ -]?){12,18}\d\b"
PLACEHOLDERS = {"email": "[REDACTED-EMAIL]", "ssn": "[REDACTED-SSN]", "card": "[REDACTED-CC]"}
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}]"
MOST_CHARS = 8192
INJECTIONS = {
    "direct-prompt-injection": r"(?i)\b(?:ignore|disregard|forget)\s+(?:all\s+|the\s+)?(?:previous|prior|above|earlier)\b",
    "jailbreak-attempt": r"(?i)\b(?:you\s+are\s+now|act\s+as|roleplay\s+as|pretend\s+to\s+be)\s+(?:a|an)?\s*(?:dan|jailbroken|unrestricted|sudo|dev\s*mode)\b",
    "system-prompt-extraction": r"(?i)\b(?:repeat|reveal|print|show)\s+(?:your|the)\s+(?:system\s+prompt|initial\s+instructions|hidden\s+instructions)\b",
}
ECHO = r"(?i)You are (?:a |the )?(?:helpful )?assistant"
CREDENTIAL = r"\b(?:sk-[a-zA-Z0-9]{20,}|AKIA[0-9A-Z]{12,}|ghp_[a-zA-Z0-9]{20,})\b"
FNV_BASIS, FNV_PRIME, U32 = 2166136261, 16777619, 4294967295


def word_tokens(text) -> Column:
    """Lower-cased words with multiplicity; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0), F.array().cast("array<string>"))


def bow_tokens(text) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(BOW_TOKEN), 0), F.array().cast("array<string>"))


def fnv1a(token) -> Column:
    """32-bit FNV-1a over an ASCII token, as a long. Products stay under 2^57, so ANSI arithmetic never overflows."""
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(FNV_BASIS).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(U32)))


def visible(text) -> Column:
    """The text without invisible characters."""
    return F.regexp_replace(text, INVISIBLE, "")


def _column(text) -> Column:
    return F.col(text) if isinstance(text, str) else text


def findings(text, clean: Column | None = None) -> Column:
    """Names of what an input shows: invisible-characters-stripped, input-truncated-from-<length>, and the injection
    patterns, in that order. ``clean`` is :func:`visible` of the text where a plan has it as a column already."""
    clean = visible(text) if clean is None else clean
    found = [F.when(clean != _column(text), F.lit("invisible-characters-stripped")), F.when(F.length(clean) > MOST_CHARS, F.concat(F.lit("input-truncated-from-"), F.length(clean)))]
    cut = F.substring(clean, 1, MOST_CHARS)
    return F.array_compact(F.array(*found, *[F.when(F.regexp_like(cut, F.lit(p)), F.lit(name)) for name, p in INJECTIONS.items()]))


def sanitised(text) -> Column:
    return F.substring(visible(text), 1, MOST_CHARS)


def is_safe(found: Column) -> Column:
    """Only cosmetic findings."""
    return ~F.arrays_overlap(found, F.array(*map(F.lit, INJECTIONS)))


def output_flags(text) -> Column:
    return F.array_compact(F.array(F.when(F.regexp_like(text, F.lit(ECHO)), F.lit("system-prompt-echo")), F.when(F.regexp_like(text, F.lit(CREDENTIAL)), F.lit("credential-leak"))))


def telltales(text, clean: Column | None = None) -> Column:
    """Findings and output flags of one text; none for a null or empty one."""
    return F.when(F.length(text) > 0, F.concat(findings(text, clean), output_flags(text))).otherwise(F.array().cast("array<string>"))


def is_hard(found: Column) -> Column:
    """An injection pattern or a prompt echo; credentials and cosmetic findings are soft."""
    return F.arrays_overlap(found, F.array(*map(F.lit, [*INJECTIONS, "system-prompt-echo"])))


def injection_score(text) -> Column:
    """1.0 for a hard finding, else 0.0."""
    return F.when(is_hard(telltales(text)), 1.0).otherwise(0.0)


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _cards_masked(text: Column) -> Column:
    """Card numbers of 13 to 19 digits with a valid check digit masked: the text is taken apart at card-shaped numbers
    and put together again."""
    shown = F.regexp_extract_all(text, F.lit(CARD), F.lit(0))
    digits = lambda m: F.regexp_replace(m, "[ -]", "")
    masked = F.transform(shown, lambda m: F.when(F.length(digits(m)).between(13, 19) & _luhn(digits(m)), PLACEHOLDERS["card"]).otherwise(m))
    parts = F.zip_with(F.split(text, CARD, -1), masked, lambda piece, m: F.concat(piece, F.coalesce(m, F.lit(""))))
    return F.when(F.regexp_like(text, F.lit(CARD)), F.array_join(parts, "")).otherwise(text)


def redacted(rows, text: str = "text"):
    """``rows`` with e-mail addresses, then social security numbers, then valid card numbers of ``text`` masked. Each step
    is a column of its own, so that the next one does not repeat it. An address starts where its run of characters does:
    said so, the pattern takes linear time on texts without blanks."""
    begin = r"(?:\G|(?<![A-Za-z0-9._%+\-]))"
    mailed = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, begin + EMAIL.replace("]+@", "]++@"), PLACEHOLDERS["email"])).otherwise(F.col(text))
    rows = rows.withColumn(text, mailed).withColumn(text, F.regexp_replace(text, SSN, PLACEHOLDERS["ssn"]))
    return rows.withColumn(text, _cards_masked(F.col(text)))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Lower-case hex HMAC from two nested digests with precomputed pads: no Python per row."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def url_key(text) -> Column:
    """Base64url without padding."""
    return F.translate(F.base64(F.encode(text, "UTF-8")), "+/=\r\n", "-_")


def point_id(text) -> Column:
    """A deterministic id: the first 16 bytes of SHA-256, as hexadecimal groups."""
    h = F.sha2(text, 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def tokens_estimated(text) -> Column:
    """Token count where no vocabulary is at hand: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / F.lit(4)).cast("long")

"""Column builders over message text, with SQL text for the same expressions where an oracle needs it."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.strip() sees it, as ranges of code points (fixed values).
WS_RANGES = [(0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
#: The same as a character class, in a form that Java and RE2 share.
WS = "[" + "".join(r"\x{%x}-\x{%x}" % r for r in WS_RANGES) + "]"
WS_RE2 = WS
WS_CHARS = "".join(chr(c) for low, high in WS_RANGES for c in range(low, high + 1))
WS_NOT_LF = WS.replace(r"[\x{9}-\x{d}", r"[\x{9}\x{b}-\x{d}")
WORD = r"[\p{L}\p{N}_]"
#: A word boundary as Python sees it.
B = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

ROLES = ("user", "assistant")
# Budgets in tokens by profile (fixed values).
PROFILES = {"lite": 4000, "standard": 16000, "full": 64000}
CHARS_PER_TOKEN = 4

# Secret patterns, in order of evaluation (fixed values): name, Java pattern, RE2 pattern for ASCII input.
# In the Java form the boundary before the first letter is looked for behind the literal, so that it costs nothing elsewhere.
SECRETS = [
    ("openai_style_key", rf"sk-(?<!{WORD}sk-)[A-Za-z0-9_-]{{16,}}{B}", r"\bsk-[A-Za-z0-9_-]{16,}\b"),
    ("github_token", rf"gh(?<!{WORD}gh)[opsu]_[A-Za-z0-9]{{20,}}{B}", r"\bgh[opsu]_[A-Za-z0-9]{20,}\b"),
    ("aws_access_key", rf"AKIA(?<!{WORD}AKIA)[0-9A-Z]{{16}}{B}", r"\bAKIA[0-9A-Z]{16}\b"),
    ("bearer_token", rf"(?iu)Bearer(?<!{WORD}Bearer){WS}+[A-Za-z0-9._~+/-]{{20,}}", r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]{20,}"),
    ("private_key_header", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
]
# From a key's header to its end or the end of the text (fixed value).
KEY_BLOCK = r"(?s)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----.*?(?:-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|\z)"
# What stands for a secret, and the name of a whole key block (fixed values).
REDACTED, KEY_MATERIAL = "[REDACTED:{}]", "private_key_material"
# Runtime markers, counted without case (fixed values).
MARKERS = ["client-bootstrap", "accessToken", "sessionToken", "authorization", "statsig"]
# State vocabulary (fixed values): English words between word boundaries and without case, Chinese words anywhere.
STATE_ENGLISH = "todo|next|pending|unresolved|blocker|blocked|waiting|remaining|error|failed|failure|pass|passed|verified|confirmed|version|commit|sha|merge|merged|issue|pull request|constraint|required|requirement|must|never|do not|current breakpoint|next action"
STATE_CHINESE = "下一步|待办|未完成|阻塞|等待|剩余|报错|错误|失败|通过|验证|确认|版本|提交|合并|关闭|问题|必须|不要|不能|隐私|安全|要求|当前|继续"
# Segments of a route that are kept, most segments, and what stands for the rest (fixed values).
ROUTE_KEPT, ROUTE_DEPTH, ROUTE_HIDDEN, ROUTE_DEEP, ROUTE_NONE = ("gemini", "share"), 12, "<redacted-segment>", "<route-too-deep>", "<unavailable>"
# What a preview shows of nothing, and behind a cut (fixed values).
PREVIEW_NONE, PREVIEW_CUT = "<none>", "\n… [preview truncated]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized(c: Column | str) -> Column:
    """Line ends as LF, runs of four or more LF as three, outer white space off."""
    t = F.regexp_replace(col(c), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    return F.btrim(t, F.lit(WS_CHARS))  # a pattern for the end would take square time on long blank runs


def normalized_text(text: str) -> str:
    """The same of a Python string."""
    return re.sub(r"\n{4,}", "\n\n\n", re.sub(r"\r\n?", "\n", text)).strip()


def normalized_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '\n{{4,}}', repeat(chr(10), 3), 'g'), '^{WS_RE2}+|{WS_RE2}+\z', '', 'g')"


def fingerprint(c: Column | str) -> Column:
    """The first 16 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(col(c), 256), 1, 16)


def message_hash(role: Column | str, norm: Column | str) -> Column:
    """SHA-256 of the role, a NUL and the normalised text."""
    return F.sha2(F.concat(col(role), F.expr("char(0)"), col(norm)), 256)


def message_hash_sql(role: str, norm: str) -> str:
    return f"sha256(concat({role}, chr(0), {norm}))"


def token_estimate(length: Column | str, per_token: int = CHARS_PER_TOKEN) -> Column:
    """0 for nothing, otherwise at least 1: the characters by ``per_token``, rounded up."""
    n = col(length)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(n / per_token))).cast("bigint")


def budget(tokens: Column | str, profile: Column | str) -> Column:
    """The stated budget, else that of the profile; null if neither or not positive."""
    by = F.lit(None).cast("int")
    for name, value in PROFILES.items():
        by = F.when(col(profile) == name, value).otherwise(by)
    b = F.coalesce(col(tokens), by)
    return F.when(b > 0, b)


def excerpt(c: Column | str, keep: int) -> Column:
    """Head and tail of a text longer than ``keep``, 7 to 3, with a note of what is left out."""
    t, head = col(c), max(1, keep * 7 // 10)
    tail = keep - head
    cut = F.concat(F.substring(t, 1, head), F.lit("\n[... "), (F.length(t) - keep).cast("string"), F.lit(" characters left out ...]\n"), F.right(t, F.lit(tail)) if tail else F.lit(""))
    return F.when(F.length(t) <= keep, t).otherwise(cut)


def excerpt_sql(x: str, keep: int) -> str:
    head = max(1, keep * 7 // 10)
    return f"CASE WHEN length({x}) <= {keep} THEN {x} ELSE left({x}, {head}) || chr(10) || '[... ' || (length({x}) - {keep}) || ' characters left out ...]' || chr(10) || right({x}, {keep - head}) END"


def state_hits(c: Column | str) -> Column:
    """Hits of the state vocabulary, English with word boundaries, Chinese without."""
    lower = F.translate(F.lower(col(c)), chr(0x17F), "s")  # the long s counts as s without case
    english = F.regexp_count(lower, F.lit(rf"(?<!{WORD})(?:{STATE_ENGLISH})(?!{WORD})"))
    return (english + F.regexp_count(col(c), F.lit(STATE_CHINESE))).cast("bigint")


def state_hits_sql(x: str) -> str:
    """The same without look-around: what parts words is doubled, so that two hits need not share it."""
    other = r"[^\p{L}\p{N}_]"
    doubled = rf"regexp_replace(replace(lower({x}), chr(383), 's'), '({other})', '\1\1', 'g')"
    english = STATE_ENGLISH.replace(" ", "  ")
    return rf"CAST(len(regexp_extract_all({doubled}, '(?:^|{other})(?:{english})(?:$|{other})')) + len(regexp_extract_all({x}, '{STATE_CHINESE}')) AS BIGINT)"


def state_hits_text(text: str) -> int:
    return len(re.findall(rf"\b(?:{STATE_ENGLISH})\b", text, re.I)) + len(re.findall(STATE_CHINESE, text))


def message_hash_text(role: str, text: str) -> str:
    return hashlib.sha256(f"{role}\0{normalized_text(text)}".encode("utf-8", "replace")).hexdigest()


def secret_count(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern)).cast("bigint")


def escaped(c: Column | str) -> Column:
    """One more backslash before each line that reads as a role marker."""
    return F.regexp_replace(col(c), rf"(?md)^(\\*<<<(?:USER|ASSISTANT)>>>{WS_NOT_LF}*)$", r"\\$1")


def unescaped(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"(?md)^\\(\\*<<<(?:USER|ASSISTANT)>>>{WS_NOT_LF}*)$", "$1")


def message_block(index: Column | str, role: Column | str, text: Column | str) -> Column:
    """A message as a block with its number (fixed format)."""
    return F.concat(F.lit("\n### MESSAGE "), (col(index) + 1).cast("string"), F.lit(" ["), F.upper(col(role)), F.lit("]\n"), col(text), F.lit("\n"))


def block_length(index: Column | str, role: Column | str, text: Column | str) -> Column:
    """The length of that block."""
    return F.length(col(text)) + F.length(col(role)) + F.length((col(index) + 1).cast("string")) + 18


def block_length_sql(index: str, role: str, text: str) -> str:
    return f"(length({text}) + length({role}) + length(CAST({index} + 1 AS VARCHAR)) + 18)"


def preview(c: Column | str, most: int = 600) -> Column:
    t = col(c)
    return F.when(F.coalesce(t, F.lit("")) == "", PREVIEW_NONE).when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(PREVIEW_CUT))).otherwise(t)


def prompt(c: Column | str) -> Column:
    """What follows the prompt prefix of an activity title, without outer white space; empty without one."""
    t = col(c)
    after = F.when(t.startswith("Prompted: "), F.substring(t, 11, 2**30)).when(t.startswith("Prompted "), F.substring(t, 10, 2**30)).otherwise(F.lit(""))
    return F.btrim(after, F.lit(WS_CHARS))


def share_url(c: Column | str, hosts: tuple[str, ...] = ("chatgpt.com", "www.chatgpt.com", "chat.openai.com")) -> Column:
    """A share link in one of its spellings as an https link, null if it is none."""
    t = F.regexp_replace(col(c), rf"^{WS}+|{WS}+\z", "")
    full = (
        F.when(t.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F-]{27,}$"), F.concat(F.lit(f"https://{hosts[0]}/share/"), t))
        .when(t.rlike(r"^https?://"), t)
        .when(t.startswith("/share/"), F.concat(F.lit(f"https://{hosts[0]}"), t))
        .when(t.startswith("share/"), F.concat(F.lit(f"https://{hosts[0]}/"), t))
        .when(t.rlike(r"^(www\.)?chatgpt\.com/share/"), F.concat(F.lit("https://"), t))
    )
    host, path = F.lower(F.regexp_extract(full, r"^https?://([^/?#]*)", 1)), F.regexp_extract(full, r"^https?://[^/?#]*([^?#]*)", 1)
    return F.when(host.isin(*hosts) & path.rlike(r"^/share/[^/]+"), full)


def safe_path(c: Column | str, suffixes: tuple[str, ...] = (".json", ".jsonl", ".ndjson", ".txt", ".html", ".htm", ".aicb")) -> Column:
    """Whether a path stays in its folder, by its text alone, and has an allowed suffix."""
    p = col(c)
    return ~p.rlike(r"^[/\\]|^[A-Za-z]:|\\|:|[\x00-\x1f\x7f]|(^|/)\.\.(/|$)|(^|/)\.?(/|$)") & F.lower(p).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def route_shape(c: Column | str) -> Column:
    """A path in which every segment off the list is hidden; empty segments don't count."""
    parts = F.filter(F.split(col(c), "/"), lambda s: s != "")
    shown = F.transform(parts, lambda s: F.when(F.lower(s).isin(*ROUTE_KEPT), F.lower(s)).otherwise(F.lit(ROUTE_HIDDEN)))
    return F.when(col(c).isNull(), ROUTE_NONE).when(F.size(parts) > ROUTE_DEPTH, ROUTE_DEEP).otherwise(F.concat(F.lit("/"), F.array_join(shown, "/")))


def captured(c: Column | str) -> Column:
    """A text with white space as a page capture leaves it."""
    t = col(c)
    for pattern, instead in ((r"\x{a0}", " "), (r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        t = F.regexp_replace(t, pattern, instead)
    return F.btrim(t, F.lit(WS_CHARS))


def captured_sql(x: str) -> str:
    for pattern, instead in ((r"\x{a0}", "' '"), (r"\r\n?", "chr(10)"), (r"[ \t]+\n", "chr(10)"), (r"\n[ \t]+", "chr(10)"), (r"[ \t]{2,}", "' '"), (r"\n{3,}", "repeat(chr(10), 2)")):
        x = f"regexp_replace({x}, '{pattern}', {instead}, 'g')"
    return rf"regexp_replace({x}, '^{WS_RE2}+|{WS_RE2}+\z', '', 'g')"


ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"


def iso_micros(c: Column | str) -> Column:
    """Microseconds since 1970 of an ISO timestamp with a zone; null for anything else."""
    t = F.btrim(col(c), F.lit(WS_CHARS))
    return F.when(t.rlike(ISO), F.unix_micros(F.try_to_timestamp(t)))


def iso_micros_sql(x: str) -> str:
    t = rf"regexp_replace({x}, '^{WS_RE2}+|{WS_RE2}+\z', '', 'g')"
    return f"CASE WHEN regexp_matches({t}, '{ISO}') THEN epoch_us(TRY_CAST({t} AS TIMESTAMPTZ)) END"


# What a text must hold to be tried as each format (fixed values).
SNIFFS = {"compact_txt": r"(?m)^<<<(?:USER|ASSISTANT)>>>?", "clean_html": "chatgpt-migrator-clean-data", "stream_html": "streamController.enqueue", "line": "linear_conversation"}


def sniffed(c: Column | str) -> dict[str, Column]:
    """Whether a text is to be tried as compact text, a clean page, a page with a stream, or a chat export."""
    t = F.coalesce(col(c), F.lit(""))
    return {
        "compact_txt": t.rlike(SNIFFS["compact_txt"]), "clean_html": F.contains(t, F.lit(SNIFFS["clean_html"])), "stream_html": F.contains(t, F.lit(SNIFFS["stream_html"])) & F.contains(t, F.lit(SNIFFS["line"])),
        "claude_json": t.rlike(r"^\s*[\[{]") & F.contains(t, F.lit('"chat_messages"')),
    }


def deduplicated(c: Column | str) -> Column:
    """The elements of an array once each, in the order of their first places."""
    return F.array_distinct(col(c))

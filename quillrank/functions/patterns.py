"""Fixed values shared by the Spark expressions and the DuckDB oracle.

Every pattern here is written so that Java regex (Spark) and RE2 (DuckDB)
read it the same way: no look-around, no back-references, explicit
character classes instead of ``\\s``.
"""

# Characters that Python's unicode str.split() treats as
# whitespace, written as one character class body.
WS_CLASS = (
    r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# The same characters as a literal string, for translate() to a plain space.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
NON_WS = "[^" + WS_CLASS + "]+"          # one whitespace-delimited word
WS_RUN = "[" + WS_CLASS + "]+"           # a run of whitespace
SENT_PIECE_WORD = "[^" + WS_CLASS + ".]+"  # a word inside one '.'-separated piece

# The marker that ends the body for the text measures.
NOTES_MARKER = "Notes and references"

# Back-matter headings stripped before readability, in the
# order they are applied.
BACK_MATTER_HEADINGS = [
    "Band members",
    "Filmography",
    "Bibliography",
    "Selected bibliography",
    "Selected filmography",
    "Selected works",
    "Discography",
    "Notes and references",
    "See also",
    "References",
    "External links",
    "Further reading",
]
BACK_MATTER_MARKERS = [f"== {h} ==" for h in BACK_MATTER_HEADINGS]

# Tokens left out of the optional word count.
WORD_STOP_TOKENS = ["==", "Further", "reading", "Notes", "References"]

# Section separator counted for nSections.
SECTION_SEP = "\n\n=="

# Readability tokenizer (our definition; see README).
READ_WORD = r"[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*"
# The same words without a repeated group, which Java's regex walks by recursion:
# an apostrophe or hyphen inside a word becomes a private character first.
READ_JOINER = r"(?<=[\p{L}\p{N}])['-](?=[\p{L}\p{N}])"
READ_JOINED = "\ue000"
READ_JOINED_WORD = r"[\p{L}\p{N}\x{E000}]+"
READ_VOWEL_GROUP = "[aeiouyáéíóúàèêäöü]+"
READ_SILENT_E = "[^aeiouyl]e$"
SILENT_E_KEEP = list("aeiouyl")  # the same rule as READ_SILENT_E, as a character list
READ_SENT_END = "[.!?]+"

# HTML extraction.
HTML_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
# An element that is never closed goes on to the end of the page.
HTML_ARTICLE = r"(?is)<article[^>]*>(.*?)(?:</article>|\z)"
HTML_BODY = r"(?is)<body[^>]*>(.*?)(?:</body>|\z)"
HTML_DROP = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title[^>]*>.*?</title>|<h1[^>]*>.*?</h1>"
HTML_HEADING = r"(?is)<h[2-6][^>]*>(.*?)</h[2-6]>"
HTML_BLOCK = r"(?i)<(?:p|br|div|li|tr|ul|ol|table|blockquote|section)\b[^>]*>"
HTML_TAG = r"<[^>]*>"
HTML_EDGE_WS = r"^[ \t\n\r]+|[ \t\n\r]+$"
# An href in double quotes, single quotes or none (quotes are cut off afterwards).
HREF_VALUE = r"""("[^"]*"|'[^']*'|[^ \t\n\r"'>]+)"""
HTML_HREF = rf"(?is)<a\s[^>]*?href\s*=\s*{HREF_VALUE}"
HTML_ANCHOR = rf"(?is)<a\s[^>]*?href\s*=\s*{HREF_VALUE}[^>]*>(.*?)</a>"
HREF_QUOTES = r"""^["']|["']$"""
HTML_IMG = rf"(?is)<img\s[^>]*?src\s*=\s*{HREF_VALUE}"
HTML_CELL = r"(?is)<td[^>]*>(.*?)</td>"
# Behind a language code: two or three letters, with further parts, or "simple".
URL_DOC_KEY = r"/(?:[a-z]{2,3}(?:-[a-z]+)*|simple)/([0-9]+)"

# HTML entities decoded in titles and text; '&amp;' last.
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]

"""Character classes, patterns and fixed values of paper extraction.

The classes mean what Unicode-aware ``\\s`` and ``\\w`` mean in Python, and read the same in Java's and RE2's syntax.
"""

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_INSIDE = WS[1:-1]
WS_CHARS = "".join(chr(c) for a, b in ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)) for c in range(a, b + 1))
W = r"[\p{L}\p{N}_]"
D = r"\p{Nd}"

# fixed values: what counts as a citation
CITATION = rf"\[{D}+(?:,{WS}*{D}+)*\]|\([\p{{L}}\p{{N}}_{WS_INSIDE}]+,{WS}*{D}{{4}}[a-z]?\)|\([\p{{L}}\p{{N}}_{WS_INSIDE}]+{WS}+et{WS}+al\.,{WS}*{D}{{4}}[a-z]?\)"
# fixed values: headings
HEADER_V1 = rf"^#+{WS}+(.+)$"
HEADER_V2 = rf"^#+{WS}+(.+?){WS}*#*{WS}*$"
ROMAN = rf"^(M{{0,4}}(?:CM|CD|D?C{{0,3}})(?:XC|XL|L?X{{0,3}})(?:IX|IV|V?I{{0,3}}))(?:[.)]|{WS}){WS}*(.+)$"
ROMAN_LONGEST = 120
PARAGRAPH_BREAK = rf"\n{WS}*\n"
EXCLUDED_SECTIONS = ["references", "bibliography"]
# fixed values: titles
TITLE = rf"^#{{1,2}}{WS}+(.+)$"
TITLE_REGION, TITLE_CUT, TITLE_LEAST, FALLBACK_LEAST = 4000, 300, 10, 30
WATERMARK = "open access|computer vision foundation|ieee xplore|watermark|proceedings|conference on computer vision|arxiv|preprint"
SKIP_TITLES = ["abstract", "introduction", "references", "conclusion", "related work", "acknowledgements", "acknowledgments", "preamble", "appendix", "supplementary material"]
TITLE_REJECT = rf"[@{{]|^{D}+\."
LINE_ENDS = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# fixed values: affiliation
ORGANIZATION = r"([^\n]*(?:University|Institute|Academy|Polytechnic|College|School|Department|Laboratory)[^\n]{0,80})"
ORGANIZATION_REGION, ORGANIZATION_CUT = 3000, 150
# fixed values: dates
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DATE_LABELLED = rf"(?:Date|Published|Received|Accepted){WS}*[:\-]?{WS}*([0-9]{{1,2}})[/\-]([0-9]{{1,2}})[/\-]([0-9]{{4}})"
DATE_ISO = r"((?:19|20)[0-9]{2})[/\-]([0-9]{1,2})[/\-]([0-9]{1,2})"
DATE_WORDS = rf"({'|'.join(MONTHS)})[,{WS_INSIDE}]+([0-9]{{4}})"
CONFERENCE_MONTHS = {"cvpr": 6, "iccv": 10, "wacv": 1, "eccv": 9, "neurips": 12, "icml": 7, "iclr": 5, "aaai": 2, "bmvc": 9, "accv": 12, "acm mm": 10}
CONFERENCE = rf"({'|'.join(CONFERENCE_MONTHS)})[{WS_INSIDE}\-]*((?:20|19)[0-9]{{2}})"
DATE_REGION, CONFERENCE_REGION = 2000, 5000
# fixed values: abstract, as (region, cut) by version
ABSTRACT_SIZES = {1: (3000, 1200), 2: (5000, 2000)}
ABSTRACT_HEAD = rf"abstract{WS}*[:\-]?{WS}*"
ABSTRACT_END = rf"\n{WS}*\n|\n{WS}*(?:{D}+\.?{WS}+)?(?:introduction|keywords?)"
# fixed values: references
REFERENCE_BLOCK = rf"(?:references|bibliography){WS}*[:\-]?{WS}*((?s:.+))"
REFERENCE_STOP = "^(?:appendix|supplementary|acknowledgement|acknowledgment|about the author)"
REFERENCE_START = rf"^{WS}*(?:[-*]{WS}+)?(?:\[{D}+\]|{D}+\.){WS}+"
BULLET = rf"^{WS}*[-*]{WS}+"

#: Fixed value: links to papers by an id of the older form.
PAPER_ID = r"^/[A-Z][0-9]+-[0-9]+/?$"

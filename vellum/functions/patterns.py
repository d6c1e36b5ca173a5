"""Patterns, word lists and thresholds of the document rules, in Java's regular expression dialect.

`\\p{L}\\p{N}_` stands for a word character everywhere: it is the same set in Java, in RE2 and in Python's `\\w`.
"""

# Page furniture of the bulletin.
MONTHS = "janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"
BULLETIN = "Boletim do Trabalho e Emprego"
FURNITURE_HEADER = rf"(?iu)^{BULLETIN},?\s*(?:n\.?\s*º\s*)?\d+(?:,\s*\d{{1,2}}/\d{{1,2}}/\d{{4}})?$"
FURNITURE_DATE = rf"(?iu)^\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}$"
FURNITURE_FOOTER = r"^BTE(?:\s+\d+(?:\s*\|\s*\d+)?|\s*\|\s*\d+)$"
PAGE_NUMBER = r"^\d{1,4}$"
BROKEN_FOOTER = r"^(?:BTE\s*)?\d{0,3}\s*\|\s*\d{1,4}$"
HEADER_PREFIX = rf"(?iu)^{BULLETIN}\s+\d+(?:\s+\d{{1,2}}\s+(?:{MONTHS})\s+\d(?:\s?\d){{3}})?(?=\s|$)\s*"
DATED_HEADER = rf"(?iu)\s*{BULLETIN}\s+\d+\s+\d{{1,2}}\s+(?:{MONTHS})\s+\d(?:\s?\d){{3}}(?!\d)"
GLUED_FURNITURE = rf"{BULLETIN} \d+(?![\d,])|\bBTE \d+ \| \d+\b"
MARGIN_LINES = 2

# Headings.
ORDINAL = (
    "(?:primeir|segund|terceir|quart|quint|sext|s[eé]tim|oitav|non|d[eé]cim|vig[eé]sim|trig[eé]sim|quadrag[eé]sim"
    "|quinquag[eé]sim|sexag[eé]sim|sept?uag[eé]sim|octog[eé]sim|nonag[eé]sim|cent[eé]sim)[oa]"
)
ONLY_ONE = "[úu]nic[oa]"
DESIGNATOR = r"(?:pr[ée]vi[oa]|preliminar|de\s+revis[ãa]o)(?=\s*$|\s+(?-i:[A-ZÀ-Ú«(]))"
ROMAN = r"(?-i:[IVXLC]+)(?:-\d+)?(?![\wÀ-ÿ])"
NUMBERING = rf"\d+\.?[ªº]?(?:-[A-Z])?|{ONLY_ONE}|{DESIGNATOR}|{ROMAN}|{ORDINAL}(?:\s+{ORDINAL})?"
CHAPTER = r"^(?:CAP[IÍ]TULO|T[IÍ]TULO)\s+([IVXLCD]+|\d+)\b(.*)$"
SECTION = r"^(?:SEC[ÇC][AÃ]O|Sec[çc][ãa]o)\s+([IVXLCD]+|\d+)\b(.*)$"
ANNEX = r"^ANEXO\s+((?:[IVXLCD]+|\d+)(?:\s*-\s*[A-Z](?![\wÀ-ÿ]))?|[A-Z](?![\wÀ-ÿ]))?\b(.*)$"
CLAUSE = rf"^(?:Cl[aá]usula|CL[AÁ]USULA)\s+((?iu:{NUMBERING}))\s*(.*)$"
ARTICLE = rf"^(?:Artigo|ARTIGO)\s+((?iu:{NUMBERING}))\s*(.*)$"
HEADINGS = {"capitulo": CHAPTER, "seccao": SECTION, "anexo": ANNEX, "clausula": CLAUSE, "artigo": ARTICLE}
BARE_DESIGNATOR = rf"^(?:Cl[aá]usula|CL[AÁ]USULA|Artigo|ARTIGO)\s+(?iu:{DESIGNATOR})\s*$"
PREAMBLE_LINE = r"(?iu)^Pre[âa]mbulo\s*$"
CONSOLIDATED_MARK = r"^Texto consolidado\b"

# Lines.
LIST_MARKER = r"\d+\s*[-–—.)]|[a-z]\)|[ivxl]+\)|[-–—•§]\s?"
STRUCTURE_MARKER = (
    r"(?-i:Cl[aá]usula\s|CL[AÁ]USULA\s|Artigo\s|ARTIGO\s|CAP[IÍ]TULO\s|Cap[ií]tulo\s|SEC[ÇC][AÃ]O\s|Sec[çc][ãa]o\s"
    r"|ANEXO\b|Anexo\b|NOTA\b|Nota\b|DECLARA[ÇC][ÃA]O\b|Declara[çc][ãa]o\b)"
)
ANY_MARKER = rf"(?iu)^(?:{LIST_MARKER}|{STRUCTURE_MARKER})"
LIST_LINE = rf"(?iu)^(?:{LIST_MARKER})"
PARAGRAPH_LINE = rf"^(?:{LIST_MARKER})"
STRONG_END = r"""[.!?:;][)\]»”"']*\s*$"""
SENTENCE_END = r"""[.!?:][)\]»”"']*\s*$"""
ANY_END = r"""[.:;,!?][)\]»”"']*\s*$"""
SPLIT_ORDINAL = r"(\d)\s*\.\s+([ºª])"
GLUED_NUMBER = r"(?m)^(\d+(?:\.\d+)?)(?=[A-ZÀ-Ú])"
TITLE_END = (
    r"(?iu)(?:revis[ãa]o\s+(?:global|parcial)|altera[çc][ãa]o\s+salarial(?:\s+e\s+outras?)?|[-–—]\s*altera[çc][ãa]o"
    r"|(?:e\s+)?texto\s+consolidado|acordo\s+de\s+ades[ãa]o|1\.?[ªa]\s+conven[çc][ãa]o)\s*$"
)
HEAD_LINES = 20
LEADING_DASH = r"^\s*[-–—]\s*\S"
ROMAN_LINE = r"^\s*[IVXLC]{1,5}\s*$"
CLAUSE_LETTERS_GO_ON = r"^[a-z]\)\s+(?:e\b|ou\b|[a-zà-ú])"
SIGNATURE = r"(?iu)^(?:Pel[ao]s?\s|Depositado em\b|Pel['´]\s?)"
SIGNING_DATE = r"^[A-ZÀ-Ú][\wà-ÿ\s]*,\s+\d{1,2}\s+de\s+[a-zç]+\s+de\s+\d{4}\s*\.?\s*$"
LINKING_WORDS = ["a", "o", "as", "os", "de", "da", "do", "das", "dos", "e", "em", "na", "no", "nas", "nos", "para", "por", "com", "à", "ao", "aos", "às"]
MOST_LOWER_WORDS = 3
LOWER_WORD = r"(?<![\w-])[a-zà-ÿ][\wà-ÿ]*"
REFERENCE_REST = r"^\s*[,;]"
ITEM_END = r"[,;]\s*$"
EURO_VALUE = r"\d,\d{2}\s*€|€\s*\d"
REVOKED = r"(?iu)^[(\[]?\s*revogad[oa]s?\s*\.?\s*[)\]]?$"
OMITTED = r"[(\[]\s*(?:(?:\.\s*){3}|…)\s*[)\]]"
ONLY_OMITTED = rf"^{OMITTED}\s*\.?$"
OMITTED_AT_END = rf"\s*{OMITTED}\s*\.?$"
MOST_TITLE, LEAST_SENTENCE_WORDS = 90, 7
RULE_TRIM = " -–—:"
GLUED_LIST_NUMBER = r"^(\d+)(?=[A-ZÀ-Ú])"
FUSED_LETTER = r";\s+([a-zà-ú]\)\s+[A-ZÀ-Ú])"
LEGAL_BULLET = r"^\s*[-*+•]\s+(?:\d+(?:\s*[-–—.)]|[A-ZÀ-Ú])|[a-zà-ú]\))"

# Words and amounts.
WORD = r"[\p{L}\p{N}_]+"
AMOUNT = r"(?<![\d.,])(?:\d{1,3}(?:[ . ]\d{3})+|\d+)[,.]\d{2}(?!\d)"
SOFT_END = "[-\u0002­￾]\n(?=[a-zà-ÿ])"
REVERSED_WORD = r"^[a-zà-ÿ]{2,}[A-ZÀ-Ý]$"
WRAPPED = r"(\p{L}{2,})[ \t]*-[ \t\n]+(\p{L}{2,})"

# Measures.
COVERAGE_OK, COVERAGE_FAIL, EXCESS_OK, ORDER_OK = 0.995, 0.97, 0.005, 0.97
LONG_LINE, LEAST_SEGMENT, MOST_SEGMENTS, MOST_SEGMENT_CHARS = 600, 4, 12, 300
NUMERIC_SHARE, PROSE_WORDS, BLIND_SHARE, FAIL_REVERSED = 0.4, 10, 0.5, 5

# Sanity rules.
DEPOSIT = r"(?iu)\bDepositad[oa]\s+(?:em|a)\s+\d"
RECTIFICATION = r"(?iu)\bRECT\b|[-–]RECT$|retifica"
CLOSED_SENTENCE = r"""(?:[.!?]|\d\.?\s?[ªº])[\s)\]»”"']*$"""
ANNOUNCEMENT = r"(?iu)(reda[çc][ãa]o|termos seguintes|forma seguinte|seguinte teor|aditad[oa]s?|republicad[oa]s?)\b[^:]*:$"
NO_SENTENCES = r" \| |\(\s*(?:\.\s*){3}\)|\(\s*…\s*\)|\[\s*(?:\.\s*){3}\]|[=×]"
TITLE_RECTIFICATION = r"(?iu)\s[-–—]\s*re(?:c)?tifica[çc][ãa]o\b"
TITLE_SALARY_CHANGE = r"(?iu)\s[-–—]\s*altera[çc][ãa]o\s+salarial\b"
HEADING_SHAPE = r"^(?:Cl[aá]usula|CL[AÁ]USULA|Artigo|ARTIGO)\s"
STRUCTURAL_HEADING = r"^(?:Cl[aá]usula|CL[AÁ]USULA|Artigo|ARTIGO|CAP[IÍ]TULO|T[IÍ]TULO)\b"
MOST_TITLE_LINES, BODY_TAIL_WORDS, HEADING_WORDS = 8, 6, 3
TABLE_ANNEX = r"(?iu)remunera|sal[áa]ri|venciment|mapa|escal[ãa]o|carreir|n[íi]vel"
VALUE_ANNEX = r"(?iu)tabela|remunera|sal[áa]ri|venciment|retribui"
VALUE = r"\d(?:[\d .]*\d)?,\d{2}\b"
LEAST_VALUES, LEAST_TEXT_LINES = 3, 3
LEVEL = r"\b(?:N[íi]vel|Grupo|Grau|Escal[ãa]o)\s+(?:[IVXLCD]+|\d+)\b"
CLASSIFICATION = r"(?iu)enquadramento|categori|profiss"
CATEGORY_WORD = r"[A-Za-zÀ-ÿ]{3,}"
NOTE_RECTIFICATION = "retificação sem articulado próprio: zero cláusulas é o esperado"
NOTE_NO_STRUCTURE = "nenhuma cláusula ou artigo reconhecido: estrutura não reconhecida pelo extrator, ou documento sem articulado — verificar o PDF"
NOTE_SALARY_CHANGE = (
    "alteração salarial sem articulado: o texto tem só números e tabelas, sem nenhuma linha com a forma de cláusula ou artigo — zero cláusulas é o esperado"
)

# Ordinals spelled out, by stem.
ORDINALS = {
    "primeir": 1, "segund": 2, "terceir": 3, "quart": 4, "quint": 5, "sext": 6, "setim": 7, "oitav": 8, "non": 9,
    "decim": 10, "vigesim": 20, "trigesim": 30, "quadragesim": 40, "quinquagesim": 50, "sexagesim": 60, "septuagesim": 70,
    "setuagesim": 70, "octogesim": 80, "nonagesim": 90, "centesim": 100,
}

# Catalogue index.
FAMILIES = [
    ("CCT", "convencao"), ("ACTV", "convencao"), ("ACEP", "convencao"), ("ACT", "convencao"), ("AE", "convencao"), ("DA", "convencao"),
    ("PE", "extensao"), ("PCT", "extensao"), ("PRT", "extensao"), ("AVISO", "aviso"), ("AV", "aviso"), ("AA", "adesao"),
]
ALL_FAMILIES = ("convencao", "extensao", "adesao", "aviso")
ALLOWED_HOSTS = ("bte.dgcp.mtsss.gov.pt", "bte.gep.mtsss.gov.pt", "bte.gep.msess.gov.pt")
DOCUMENT_URL = "https://bte.dgcp.mtsss.gov.pt/documentos"
DOWNLOAD_STATES = ("por_descarregar", "descarregado", "ja_existente", "inalterado", "falhado", "ignorado")
SEVERITIES = ("info", "warning", "error")
GATES = ("passed", "review", "blocked")

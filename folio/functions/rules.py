"""Rule tables of the text functions; every function takes another table as a parameter."""

from __future__ import annotations

# Characters and what stands for them.
CHARACTERS = {
    "\u00a0": " ",
    "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": "",
    "\u2013": " — ", "\u2014": " — ",
    "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"',
    "\u2026": "...",
    "\u00ab": '"', "\u00bb": '"',
    "\u2022": "", "\u25cf": "", "\u25cb": "", "\u25a0": "", "\u25a1": "", "\u25aa": "", "\u25ab": "", "\u25b6": "", "\u25c0": "", "\u2023": "", "\u2043": "", "\u204b": "",
    "\u2020": "", "\u2021": "", "\u00a7": "", "\u00b6": "",
    "\u00b0": " gradi ",
    "\u00b9": "", "\u00b2": "", "\u00b3": "", "\u2070": "", "\u2074": "", "\u2075": "", "\u2076": "", "\u2077": "", "\u2078": "", "\u2079": "",
}

# Markup left in texts: pattern, replacement, and what a text must hold for it ("": anything), in the order of application.
RESIDUE = (
    (r"(?m)^#{1,6}\s*", "", "#"),
    (r"(?<!\w)#+(?!\w)", "", "#"),
    (r"\*{1,3}(\S)", "$1", "*"),
    (r"(\S)\*{1,3}", "$1", "*"),
    (r"_{2,}", "", "__"),
    (r"~{2,}", "", "~~"),
    (r"`+", "", "`"),
    (r"\|", " ", "|"),
    (r"\\(?![nrt])", "", "\\"),
    (r"<[^>]+>", "", "<"),
    (r"&\w+;", "", "&"),
    (r"&#\d+;", "", "&#"),
)

# Noise in lines: pattern, replacement, and a pattern of what a line must hold for it, in the order of
# application. A line that one of them matches at its start goes as a whole (where the replacement is empty) or becomes the replacement.
NOISE = (
    (r"\[\d+\]", "", r"\["),
    (r"\{\d+\}", "", r"\{"),
    (r"\[[a-z]\]", "", r"\["),
    (r"[\u00b9\u00b2\u00b3\u2070-\u2079]+", "", r"[\u00b9\u00b2\u00b3\u2070-\u2079]"),
    (r"[\u2020\u2021]", "", r"[\u2020\u2021]"),
    (r"[\u00a7\u00b6]", "", r"[\u00a7\u00b6]"),
    (r"^\s*#{1,6}\s+", "", "#"),
    (r"#{2,}", "", "##"),
    (r"https?://\S+", "", "https?:"),
    (r"\S+@\S+\.\S+", "", "@"),
    (r"ISBN[\s:-]*[\d-]{10,}", "", "ISBN"),
    (r"doi[\s:]*10\.\S+", "", "doi"),
    (r"\bp+\.\s*\d[\d\s,\-–—]+", "", r"p\.\s*\d"),
    (r"\([Vv]edi\s+[^)]*\)", "", r"\("),
    (r"\([Ss]ee\s+[^)]*\)", "", r"\("),
    (r"\([Cc]fr\.?\s+[^)]*\)", "", r"\("),
    (r"\[\s*\]", "", r"\["),
    (r"\|", " ", r"\|"),
    (r"\\(?!\w)", "", r"\\"),
)

# Abbreviations and what is read for them.
ABBREVIATIONS = {
    "ecc.": "eccetera", "etc.": "eccetera",
    "pag.": "pagina", "pagg.": "pagine", "cap.": "capitolo", "capp.": "capitoli", "vol.": "volume", "voll.": "volumi",
    "fig.": "figura", "figg.": "figure", "tab.": "tabella", "tabb.": "tabelle",
    "cfr.": "confronta", "cit.": "citato", "op. cit.": "opera citata", "ibid.": "ibidem",
    "n.d.r.": "nota del redattore", "n.d.t.": "nota del traduttore", "n.d.a.": "nota dell'autore",
    "es.": "esempio", "ad es.": "ad esempio", "p.es.": "per esempio",
    "sig.": "signor", "sig.ra": "signora", "dott.": "dottor", "dott.ssa": "dottoressa", "prof.": "professor", "prof.ssa": "professoressa",
    "avv.": "avvocato", "ing.": "ingegner", "arch.": "architetto", "geom.": "geometra",
    "sez.": "sezione", "par.": "paragrafo", "art.": "articolo", "artt.": "articoli", "lett.": "lettera",
    "c.d.": "cosiddetto", "ca.": "circa", "sec.": "secolo", "a.C.": "avanti Cristo", "d.C.": "dopo Cristo",
    "e.g.": "for example", "i.e.": "that is", "vs.": "versus",
    "Dr.": "Doctor", "Mr.": "Mister", "Mrs.": "Missis", "St.": "Saint", "Jr.": "Junior", "Sr.": "Senior",
}

# Parts of titles of sections that are no content.
SKIPPED_TITLES = (
    "indice", "indice generale", "indice dei contenuti", "indice analitico", "sommario", "table of contents", "contents", "toc",
    "table des matières", "sommaire", "índice", "índice general", "inhaltsverzeichnis", "inhalt",
    "copyright", "colophon", "note legali", "informazioni legali", "avviso legale", "legal notice", "all rights reserved",
    "copyright notice", "mentions légales", "aviso legal", "impressum",
    "frontespizio", "title page", "cover", "copertina", "half title", "halftitle", "page de titre",
    "dedica", "dedication", "dédicace", "dedicatoria", "epigrafe", "epigraph", "épigraphe",
    "bibliografia", "bibliography", "bibliographie", "bibliografía", "riferimenti bibliografici", "riferimenti", "references",
    "opere citate", "works cited", "fonti", "sources", "letture consigliate", "further reading", "suggested reading",
    "per approfondire", "lectures complémentaires",
    "note", "notes", "note al testo", "note a piè di pagina", "note finali", "endnotes", "footnotes", "anmerkungen",
    "note dell'autore", "note del traduttore", "note del curatore", "note bibliografiche", "note critiche",
    "glossario", "glossary", "glossaire", "glosario", "glossar",
    "indice analitico", "indice dei nomi", "indice dei luoghi", "indice delle opere", "indice tematico",
    "index", "name index", "subject index", "word index",
    "appendice", "appendix", "annexe", "apéndice", "anhang",
    "about the author", "sull'autore", "l'autore", "l'autrice", "biography", "biografia", "biographie",
    "about the translator", "nota del traduttore", "dello stesso autore", "also by", "du même auteur", "altre opere", "other books",
    "ringraziamenti", "acknowledgements", "acknowledgments", "remerciements", "agradecimientos", "danksagung",
    "errata", "errata corrige", "credits", "crediti", "photo credits", "image credits", "illustration credits",
)

# Signals of a colophon; two of them in the first 500 characters reject a text.
COLOPHON = (
    "tutti i diritti", "all rights reserved", "tous droits", "prima edizione", "first published", "printed in",
    "stampato in", "finito di stampare", "tipografia", "isbn", "© ", "propriet", "vietata la riproduzione",
)

# Names of files without content (stem in lower case without - and _).
FILES_EXACT = (
    "toc", "nav", "contents", "cover", "colophon", "copyright", "titlepage", "halftitle", "frontmatter", "backmatter",
    "landmarks", "dedication", "epigraph", "notes", "endnotes", "footnotes", "biblio", "bibliography", "references", "glossary",
)
FILES_PART = ("bibliography", "footnotes", "endnotes", "glossary", "colophon", "frontmatter", "backmatter", "tableofcontents")

# HTML elements that go with their content, that are blocks, and headings.
DROPPED_TAGS = (
    "script", "style", "nav", "aside", "footer", "header", "figcaption", "figure", "table", "svg", "math", "code", "pre", "sup", "sub",
    "noscript", "iframe", "object", "embed", "canvas", "form", "input", "select", "textarea", "button", "map", "area",
)
BLOCK_TAGS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "section", "article", "br", "hr")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Parts of classes and ids of elements that go.
DROPPED_CLASSES = (
    "footnote", "footnotes", "endnote", "endnotes", "note", "notes", "noteref", "noterefs", "fn", "fnref",
    "pagenum", "page-number", "pageno", "page-break", "running-head",
    "toc", "table-of-contents", "contents", "calibre_toc", "toc-entry", "toc-item", "toc-link", "toc-list",
    "index", "index-entry", "index-item", "index-group", "book-index", "subject-index", "name-index",
    "bibliography", "references", "biblio", "bib-entry", "citation", "citations", "works-cited", "further-reading",
    "ref-list", "reference-list", "sources",
    "sidebar", "pullquote", "infobox", "textbox", "tip", "warning",
    "copyright", "colophon", "imprint", "legal",
    "glossary", "glossary-entry", "glossary-term", "glossary-def",
    "appendix-notes", "editorial-note", "editors-note", "translator-note", "pub-info", "book-info",
)

# Roles, epub:type values and link targets of elements that go.
DROPPED_ROLES = ("navigation", "complementary", "contentinfo", "note", "directory", "doc-bibliography", "doc-endnotes", "doc-glossary", "doc-index", "doc-toc")
DROPPED_TYPES = (
    "footnote", "footnotes", "endnote", "endnotes", "noteref", "annotation", "rearnote", "rearnotes",
    "bibliography", "biblioentry", "glossary", "glossterm", "glossdef",
    "index", "index-headnotes", "index-group", "index-entry", "index-term", "index-locator",
    "toc", "landmarks", "lot", "loi", "loa", "colophon", "imprint", "copyright-page", "errata", "appendix",
    "contributors", "other-credits", "acknowledgments",
)
NOTE_LINKS = ("#note", "#fn", "#endnote", "#footnote", "#ref", "#bib", "#cite", "#annot", "#en-", "#sdfootnote", "#_ftn", "#_edn")

# Languages of voices.
LANGUAGES = {
    "af": "Afrikaans", "am": "Amarico", "ar": "Arabo", "az": "Azerbaigiano", "bg": "Bulgaro", "bn": "Bengalese", "bs": "Bosniaco", "ca": "Catalano",
    "cs": "Ceco", "cy": "Gallese", "da": "Danese", "de": "Tedesco", "el": "Greco", "en": "Inglese", "es": "Spagnolo", "et": "Estone",
    "fa": "Persiano", "fi": "Finlandese", "fil": "Filippino", "fr": "Francese", "ga": "Irlandese", "gl": "Galiziano", "gu": "Gujarati", "he": "Ebraico",
    "hi": "Hindi", "hr": "Croato", "hu": "Ungherese", "id": "Indonesiano", "is": "Islandese", "it": "Italiano", "ja": "Giapponese", "jv": "Giavanese",
    "ka": "Georgiano", "kk": "Kazako", "km": "Khmer", "kn": "Kannada", "ko": "Coreano", "lo": "Lao", "lt": "Lituano", "lv": "Lettone",
    "mk": "Macedone", "ml": "Malayalam", "mn": "Mongolo", "mr": "Marathi", "ms": "Malese", "mt": "Maltese", "my": "Birmano", "nb": "Norvegese Bokmal",
    "ne": "Nepalese", "nl": "Olandese", "pl": "Polacco", "ps": "Pashto", "pt": "Portoghese", "ro": "Romeno", "ru": "Russo", "si": "Singalese",
    "sk": "Slovacco", "sl": "Sloveno", "so": "Somalo", "sq": "Albanese", "sr": "Serbo", "su": "Sundanese", "sv": "Svedese", "sw": "Swahili",
    "ta": "Tamil", "te": "Telugu", "th": "Thailandese", "tr": "Turco", "uk": "Ucraino", "ur": "Urdu", "uz": "Uzbeco", "vi": "Vietnamita",
    "zh": "Cinese", "zu": "Zulu",
}
LANGUAGE_PRIORITY = {"it": 0, "en": 1, "fr": 2, "de": 3, "es": 4, "pt": 5}
SITE_LANGUAGES = {"it": "it", "en": "en", "fr": "fr", "es": "es", "de": "de", "zh": "zh-Hans"}
COVER_NAMES = ("cover.jpg", "cover.jpeg", "cover.png", "cover-image.jpg", "cover-image.png")

# White space, in the order of application; punctuation; signs that file names and spoken text cannot hold.
# A third and further values: one of them is in every text that the rule changes.
SPACING = ((r"\t[ \t]*| [ \t]+", " ", "\t", "  "), (r" *\n *", "\n", " \n", "\n "), (r"\n{4,}", "\n\n\n", "\n\n\n\n"), (r"\n(?:[^\S\n]*\n){2}\s*", "\n\n"))
PUNCTUATION = ((r"\s+([.,;:!?])", "$1"), (r"([.,;:!?]){3,}", "$1$1"), ('"{2,}', '"', '""'))
RESERVED = r'[<>:"/\\|?*]'
UNSPOKEN = ((r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u200b-\u200f\u2028-\u202f\ufeff\ufffe\uffff]", ""), (r"\n{3,}", "\n\n"), (r" {3,}", " "))

# Chapter words before Roman numerals, numbered headings, ends of sentences in previews,
# addresses, languages of a request with their weights.
NUMERAL = r"(Capitolo|Chapter|Cap\.?|Parte|Part)\s+([MDCLXVI]+)"
# What a text in lower case holds where NUMERAL is found.
NUMERAL_SIGNS = ("cap", "chapter", "part")
HEADING = r"^(Capitolo|Chapter|Cap\.?|Parte|Part|Sezione|Section)\s*[.:—\-]?\s*(\d+|[IVXLCDM]+)\s*[.:—\-]?\s*(.*)"
SENTENCE_END = r"""[.!?][""»)\s]"""
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
ACCEPTED_LANGUAGE = r"([a-zA-Z]{2,3})(?:-[a-zA-Z0-9]+)*(?:;q=([0-9.]+))?"

# The voice of a book in the first language, and that of any other.
VOICE_LANGUAGE, VOICE_OWN, VOICE_OTHER = "it", "it-IT-IsabellaNeural", "en-US-JennyNeural"

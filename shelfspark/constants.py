"""Names, tables and addresses that must be equal everywhere for results to match."""

# Media type of each book extension (fixed values).
MEDIA_TYPES = {
    "epub": "application/epub+zip",
    "pdf": "application/pdf",
    "mobi": "application/x-mobipocket-ebook",
    "azw": "application/x-mobipocket-ebook",
    "azw3": "application/x-mobi8-ebook",
    "fb2": "application/x-fictionbook+xml",
    "fbz": "application/x-fictionbook+xml",
    "cbz": "application/vnd.comicbook+zip",
    "cbr": "application/vnd.comicbook-rar",
    "cb7": "application/vnd.comicbook+7z",
    "cbt": "application/vnd.comicbook+tar",
    "zip": "application/zip",
    "djvu": "image/vnd.djvu",
    "txt": "text/plain",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"
BOOK_EXTENSIONS = list(MEDIA_TYPES)
VIEWABLE_FORMATS = ["epub", "pdf"]

# File names of a catalog tree (fixed values).
FEED_FILE = "feed.xml"
INDEX_FILE = "index.html"
ENTRY_FILE = "entry.xml"
FOLDER_ENTRY_FILE = "_entry.xml"

# Identifier prefixes of feeds and entries (fixed values).
CATALOG_URN = "urn:opds:catalog:"
BOOK_URN = "urn:opds:book:"
ROOT_NAME = "Catalog"

# Link relations and media types of the public OPDS 1.2 specification (fixed values).
REL_ACQUISITION = "http://opds-spec.org/acquisition"
REL_OPEN_ACCESS = "http://opds-spec.org/acquisition/open-access"
REL_IMAGE = "http://opds-spec.org/image"
REL_THUMBNAIL = "http://opds-spec.org/image/thumbnail"
REL_FACET = "http://opds-spec.org/facet"
REL_GROUP = "http://opds-spec.org/group"
REL_SUBSECTION = "subsection"
COVER_RELS = ["http://opds-spec.org/image", "http://opds-spec.org/cover", "x-stanza-cover-image"]
THUMBNAIL_RELS = [
    "http://opds-spec.org/image/thumbnail",
    "http://opds-spec.org/thumbnail",
    "x-stanza-cover-image-thumbnail",
]
ATOM_TYPE = "application/atom+xml"
OPDS_JSON_TYPE = "application/opds+json"
NAVIGATION_TYPE = "application/atom+xml;profile=opds-catalog;kind=navigation"
ACQUISITION_TYPE = "application/atom+xml;profile=opds-catalog;kind=acquisition"
PACKAGE_TYPE = "application/oebps-package+xml"

# Named character references that are decoded; every other name is kept (fixed values).
ENTITIES = {
    "lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'",
    "mdash": "—", "ndash": "–", "hellip": "…", "bull": "•", "middot": "·",
    "laquo": "«", "raquo": "»", "ldquo": "\u201c", "rdquo": "\u201d", "lsquo": "\u2018",
    "rsquo": "\u2019", "sbquo": "\u201a", "bdquo": "\u201e", "nbsp": "\u00a0", "ensp": "\u2002",
    "emsp": "\u2003", "thinsp": "\u2009", "copy": "©", "reg": "®", "trade": "™",
    "deg": "°", "plusmn": "±", "times": "×", "divide": "÷", "para": "¶",
    "sect": "§", "dagger": "†", "Dagger": "‡", "permil": "‰", "euro": "€",
    "pound": "£", "yen": "¥", "cent": "¢", "larr": "←", "rarr": "→",
    "uarr": "↑", "darr": "↓",
}

# Tags that start a new block of text (fixed values).
BLOCK_TAGS = [
    "article", "aside", "audio", "blockquote", "caption", "details", "dialog", "div", "dl", "dt", "dd",
    "figure", "footer", "form", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "hr", "li", "main", "math", "nav", "ol", "p", "pre", "section", "tr",
]

# Contributor codes and the role each one stands for (fixed values).
RELATORS = {
    "art": "artist", "aut": "author", "clr": "colorist", "edt": "editor", "ill": "illustrator",
    "nrt": "narrator", "trl": "translator", "pbl": "publisher",
}

# Identifier type codes that have a URN name (fixed values).
IDENTIFIER_CODES = {"02": "isbn", "06": "doi", "15": "isbn", "26": "doi", "34": "issn"}

# Extensions of authoring tools cut from a title (fixed values).
SOURCE_SUFFIXES = ["indd", "qxd", "doc", "docx", "odt", "rtf", "pages", "tex", "pub", "wpd", "fm"]

# Image extensions: of a cover in an archive, and of a page in a comic reader (fixed values).
COVER_IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "gif"]
PAGE_IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "bmp", "webp", "svg", "jxl", "avif"]

# Record types of an EXTH block that are read (fixed values).
EXTH_TYPES = {
    100: "creator", 101: "publisher", 103: "description", 105: "subject", 106: "date", 109: "rights",
    201: "cover_offset", 202: "thumbnail_offset", 503: "title",
}

# Leading bytes, as hexadecimal text, of the archive types, and the tar mark at byte 257 (fixed values).
ARCHIVE_MAGIC = {"zip": "504B0304", "rar": "52617221", "7z": "377ABCAF"}
TAR_MARK, TAR_MARK_OFFSET = "7573746172", 257

# Characters that ECMAScript counts as white space, as a regular-expression class body (fixed values).
SPACE_CLASS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

# Suppression of repeated events, in milliseconds, and rows between two samples (fixed values).
SUPPRESS_INTERVAL_MS = 500
SUPPRESS_IDLE_MS = 2000
SAMPLE_EVERY = 50

# Characters kept on each side of a search hit (fixed value).
EXCERPT_CONTEXT = 50

"""Values that decide results and therefore have to be exactly these.

Fixed values: extension lists, folder names, caps, headers and messages.
"""

# Extension -> category.
IMAGE_EXTENSIONS = (".jpg .jpeg .png .bmp .gif .tiff .tif .webp .heic .heif .svg").split()
PDF_EXTENSIONS = (".pdf").split()
AUDIO_EXTENSIONS = (".mp3 .wav .flac .ogg .m4a .aac .opus .wma").split()
VIDEO_EXTENSIONS = (".mp4 .avi .mkv .mov .wmv .flv .webm .m4v").split()
DOCUMENT_EXTENSIONS = (
    ".txt .md .rst .csv .tsv .json .xml .yaml .yml .html .htm "
    ".docx .doc .pptx .ppt .xlsx .xls .rtf"
).split()

CATEGORIES = {
    "image": IMAGE_EXTENSIONS,
    "pdf": PDF_EXTENSIONS,
    "audio": AUDIO_EXTENSIONS,
    "video": VIDEO_EXTENSIONS,
    "document": DOCUMENT_EXTENSIONS,
}
UNKNOWN = "unknown"

# Document extension -> assembler (everything else is plain text).
DOCUMENT_ROUTES = {
    "csv": [".csv", ".tsv"],
    "json": [".json"],
    "xml": [".xml"],
    "html": [".html", ".htm"],
    "paragraphs": [".docx", ".doc"],
    "slides": [".pptx"],
    "sheets": [".xlsx", ".xls"],
}
PLAIN_TEXT_ROUTE = "plain"
FALLBACK_ROUTE = "fallback"

# Path components that hide a file from the scan.
IGNORED_NAMES = [
    ".git", ".svn", "__pycache__", ".DS_Store", "Thumbs.db", ".undo_history", "desktop.ini",
]

# Category -> second-level folder.
LEVEL2_FOLDERS = {
    "image": "Images",
    "pdf": "PDFs",
    "audio": "Audio",
    "video": "Video",
    "document": "Documents",
    "unknown": "Other",
}
LEVEL2_DEFAULT = "Other"

# First-level fallbacks.
MISC_FOLDER = "Miscellaneous"
UNKNOWN_DATE = "Unknown_Date"
NOISE_LABEL = "misc"

# Metadata used when a reply gives nothing usable.
DEFAULT_TOPIC = "Uncategorized"
REQUIRED_FIELDS = ["topic", "summary", "keywords", "confidence"]

# Thresholds and caps.
MAX_FILE_MB = 500.0
MAX_IMAGE_MB = 20
CONFIDENCE_THRESHOLD = 0.55
SLUG_CHARS = 40
FALLBACK_CHARS = 4000
PROMPT_CHARS = 4000
DOCUMENT_CHARS = 8000
HTML_CHARS = 6000
XML_CHARS = 6000
JSON_CHARS = 8000
SHEET_CHARS = 6000
PDF_CHARS = 12000
CSV_ROWS = 100
SHEET_ROWS = 50
PDF_PAGES = 10
PDF_NATIVE_MIN_CHARS = 50
AUDIO_SECONDS = 600
VIDEO_SECONDS = 3600
VIDEO_FRAMES = 5
TOPIC_CHARS = 80
SUMMARY_CHARS = 500
MAX_KEYWORDS = 10
NAMING_TOPICS = 12
CLUSTER_NAME_CHARS = 50
LISTING_ROWS = 200
KEEP_SESSIONS = 10
MODEL_BATCH = 32
KMEANS_SEED = 42
ELBOW_MIN_K = 2
ELBOW_MAX_K = 12
DBSCAN_EPS = 0.5
DBSCAN_MIN_POINTS = 2
SEARCH_K = 3

# Image tags that are reported when there is no description.
IMAGE_TAGS = [
    "DateTime", "DateTimeOriginal", "Make", "Model", "GPSInfo", "ImageDescription", "UserComment",
]

# Subtrees removed from HTML before its text is taken.
HTML_DROPPED_TAGS = ["script", "style", "nav", "footer", "header"]
# Elements of HTML without content or end tag.
HTML_VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]

# Messages.
EMPTY_REASON = "not readable / empty"
NO_DOCUMENT_TEXT = "No text extracted from document"
NO_SPEECH = "No speech detected in audio"
NO_VIDEO_METADATA = "Could not read video metadata"
NO_FRAMES = "No frames extracted from video"
NO_FRAME_TEXT = "Vision model returned no descriptions"
NO_IMAGE_TEXT = "Vision model returned no output"
NO_SESSIONS = "No undo sessions found."

# Characters Python's str.strip() removes; a rule of the Unicode tables, not a list of ours.
PY_WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

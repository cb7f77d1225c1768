"""Constants whose exact value decides a result.

Everything in this file is a fixed value: lists, patterns, limits and output
formats that callers of an existing code-retrieval service rely on.  They are
kept together, as plain text, and used nowhere but through these names.
"""

# --- fixed values: file selection -------------------------------------------
IGNORED_DIRECTORIES = (
    "node_modules", ".git", "dist", "build", ".next", "out", "coverage",
    "vendor", "__pycache__", ".venv", "venv", ".idea", ".vscode", "tmp",
    "test", "tests", "__tests__", "spec", "specs", "docs", "documentation",
    "temp",
)
IGNORED_EXTENSIONS = (
    ".lock", ".min.js", ".min.css", ".png", ".jpg", ".jpeg", ".gif", ".svg",
    ".ico", ".pdf", ".zip", ".tar", ".gz", ".exe", ".dll", ".so", ".dylib",
    ".wasm", ".pyc", ".map", ".mp4", ".mov", ".mp3", ".wav", ".ttf", ".woff",
    ".woff2",
)
IGNORED_FILENAMES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb",
    "Pipfile.lock", "poetry.lock", ".DS_Store", "Thumbs.db",
)
ALLOWED_CODE_EXTENSIONS = (
    ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".html", ".css", ".scss",
    ".json", ".yaml", ".yml", ".toml", ".csv", ".sql", ".graphql",
    ".py", ".go", ".rs", ".java", ".cpp", ".c", ".cc", ".h", ".hpp", ".cs",
    ".rb", ".php", ".swift", ".kt",
)
ALLOWED_DOC_FILENAMES = ("README.md", "readme.md", "README", "LICENSE", "CHANGELOG.md")
ALLOWED_DOC_EXTENSIONS = (".md", ".mdx", ".rst", ".txt")
MAX_FILE_SIZE_BYTES = 2 * 1024 * 1024
MAX_REPO_SIZE_BYTES = 50 * 1024 * 1024

REASON_FILENAME = "Ignored filename"
REASON_MINIFIED = "Minified file"
REASON_EXTENSION = "Ignored extension"
REASON_UNREADABLE = "Unreadable file stats"
REASON_NOT_ALLOWED = "Extension not in allowlist"

# --- fixed values: languages ------------------------------------------------
LANGUAGE_BY_EXTENSION = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java",
    ".cpp": "cpp", ".c": "c", ".cc": "cpp", ".h": "c", ".hpp": "cpp",
    ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin",
}
PARSED_LANGUAGES = ("javascript", "typescript", "python")
MARKDOWN_EXTENSIONS = (".md", ".mdx")
SYMBOL_TYPES = ("function", "class", "method", "module", "doc")

# --- fixed values: repository addresses -------------------------------------
REPO_SHORTHAND = r"^([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+)$"
REPO_HOSTS = ("github.com", "www.github.com")

# --- fixed values: text patterns --------------------------------------------
# White space as the JavaScript \s class defines it (Java's and RE2's are ASCII only).
SPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WORD_DELIMITERS = ",;(){}\\[\\]\"'"
CAMEL_BOUNDARY = "([a-z0-9])([A-Z])"
SUBTOKEN = "[a-z0-9_$]{2,}"
MARKDOWN_HEADER = "#{1,6}"
CITATION = r"[\[【]([a-zA-Z0-9_./\-]+):(\d+)(?:-(\d+))?[\]】]"
SYMBOL_NAME = "[a-zA-Z_$][a-zA-Z0-9_$]{3,}"
SYMBOL_STOP_WORDS = (
    "function", "return", "class", "import", "export", "const", "async",
    "await", "string", "number", "boolean", "object", "array", "promise",
    "undefined", "null",
)
INVENTORY_PHRASES = ("how many", "list all files", "what files", "file count")
DECLINED_PHRASE = "i don't know based on the provided codebase context"

# --- fixed values: ranking --------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
CONTENT_WEIGHT = 1
PATH_WEIGHT = 2
SYMBOL_WEIGHT = 4
TOP_K = 20
TOP_N = 8
RRF_K = 60
MIN_RRF_SCORE = 0.010
DOMINANT_GAP = 0.003
HYBRID_CONFIDENCE_FACTOR = 30
SINGLE_CONFIDENCE_FACTOR = 25
REFERENCE_TOP_K = 5
HOP_TOP_K = 3

# --- fixed values: prompt and answer formats --------------------------------
MAX_CHUNK_CHARS = 1500
MAX_CONTEXT_CHARS = 12000
MAX_INVENTORY_FILES = 100
SNIPPET_FALLBACK_CHARS = 150
TEMPERATURE = 0.1
MAX_TOKENS = 1024
REFUSAL_TEXT = (
    "I couldn't find enough relevant information in this codebase to answer that confidently."
)
DECLINED_REASON = "LLM indicated context was insufficient"
REASON_NO_CHUNKS = "No relevant code chunks found in the repository for this query."
REASON_WEAK = "Top retrieval score (%.4f) is below threshold (0.01). Context may be weak."
REASON_HYBRID = 'High confidence: Top candidate "%s:%d" matched by both semantic vectors and BM25 keywords.'
REASON_DOMINANT = "Good confidence: Clear top match in %s search."
REASON_SINGLE = "Moderate confidence: Candidate found via %s search."

# --- fixed values: models ---------------------------------------------------
CLOUD_PROVIDERS = ("gemini", "google")
CLOUD_MODEL = "models/gemini-embedding-001"
CLOUD_SECOND_MODEL = "models/gemini-embedding-2"
CLOUD_RETIRED_MODEL = "models/text-embedding-004"
LOCAL_EMBEDDING_DIM = 384
CLOUD_EMBEDDING_DIM = 768
LOCAL_BATCH = 64
CLOUD_BATCH = 20
ANSWER_MODEL = "openai/gpt-oss-120b"
ANSWER_FALLBACK_MODEL = "openai/gpt-oss-20b"
MAX_ATTEMPTS = 3

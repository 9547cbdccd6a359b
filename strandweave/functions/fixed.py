"""Fixed values that results depend on: extensions, names, patterns and words, in the order of their source."""

CODE_EXTENSIONS = (
    "py", "ts", "js", "jsx", "tsx", "mjs", "ejs", "go", "rs", "java", "cpp", "cc", "cxx", "c", "h", "hpp", "rb", "swift", "kt", "kts", "cs", "scala",
    "php", "lua", "toc", "zig", "ps1", "ex", "exs", "m", "mm", "jl", "vue", "svelte", "dart", "v", "sv", "sql", "r",
)
PAPER_EXTENSIONS = ("pdf",)
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "svg")
DOC_EXTENSIONS = ("md", "mdx", "txt", "rst", "html", "yaml", "yml")
VIDEO_EXTENSIONS = ("mp4", "mov", "webm", "mkv", "avi", "m4v", "mp3", "wav", "m4a", "ogg")
TEXT_EXTENSIONS = ("txt", "md", "mdx", "rst")

SKIPPED_DIRS = (
    "venv", ".venv", "env", ".env", "node_modules", "__pycache__", ".git", "dist", "build", "target", "out", "site-packages", "lib64", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".eggs",
)
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock", "go.sum", "go.work.sum")
SENSITIVE_NAMES = (".env", ".envrc")
SENSITIVE_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".cert", ".crt")
SENSITIVE_WORDS = ("credential", "secret", "passwd", "password", "token", "private_key")

PAPER_SIGNALS = (
    r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b", r"\\cite\{", r"\[\d+\]",
    r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b",
)
PAPER_SIGNAL_COUNT, PAPER_SCAN_BYTES, CORPUS_WARNING_WORDS = 3, 3000, 50_000

LANGUAGE_FAMILIES = {
    "python": ("py", "pyw"), "js": ("js", "jsx", "mjs", "ejs", "ts", "tsx", "vue", "svelte"), "go": ("go",), "rust": ("rs",), "jvm": ("java", "kt", "kts", "scala"),
    "c": ("c", "h", "cpp", "cc", "cxx", "hpp"), "ruby": ("rb",), "swift": ("swift",), "dotnet": ("cs",), "php": ("php",), "r": ("r",),
}
CONTEXT_WORDS = {
    "call": ("call", "calls", "called", "invoke", "invokes", "invoked"), "import": ("import", "imports", "imported", "module", "modules"),
    "field": ("field", "fields", "member", "members", "property", "properties"), "parameter_type": ("parameter", "parameters", "param", "params", "argument", "arguments"),
    "return_type": ("return", "returns", "returned"), "generic_arg": ("generic", "generics", "template", "templates"),
}
BENCHMARK_QUESTIONS = (
    "how does authentication work", "what is the main entry point", "how are errors handled", "what connects the data layer to the api", "what are the core abstractions",
)
PALETTE = ("#4E79A7", "#F28E2B", "#E15759", "#76B7B2", "#59A14F", "#EDC948", "#B07AA1", "#FF9DA7", "#9C755F", "#BAB0AC")
URL_SCHEMES = ("http", "https")
BLOCKED_HOSTS = ("metadata.google.internal", "metadata.google.com")
#: A hint for speech recognition: what precedes the topics, and what is always said.
SPEECH_HINT = ("Technical discussion about ", "Use proper punctuation and paragraph breaks.")

"""Fixed values that results depend on, stated as they are."""

# Directories and files that are never read.
IGNORED_DIRECTORIES = [".git", ".hg", ".svn", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", "coverage", ".next", ".cache", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox", ".eggs"]
IGNORED_FILES = ["package-lock.json", "poetry.lock", "Pipfile.lock", "yarn.lock", "npm-shrinkwrap.json"]

# Languages by extension.
LANGUAGES = {".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript"}

# File categories.
CONFIG_NAMES = [
    "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "requirements-dev.txt", "requirements-test.txt", "Pipfile", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "tsconfig.json", "tsconfig.node.json", "jsconfig.json", "vite.config.ts", "vite.config.js", "vite.config.mjs", "webpack.config.js", "webpack.config.ts", "rollup.config.js", "rollup.config.ts",
    "babel.config.js", "babel.config.json", ".babelrc", "jest.config.js", "jest.config.ts", "vitest.config.ts", "eslint.config.js", ".eslintrc", ".eslintrc.js", ".eslintrc.json", ".prettierrc",
    ".prettierrc.json", "prettier.config.js", "Dockerfile", "docker-compose.yml", "docker-compose.yaml", "Makefile", "Makefile.am", ".env.example", ".env.local", "tox.ini", "mypy.ini", ".mypy.ini",
    "ruff.toml", ".ruff.toml", "pytest.ini", "conftest.py", ".github", ".gitlab-ci.yml", "MANIFEST.in", "LICENSE", "LICENSE.md", "LICENSE.txt", "COPYING",
]
DOC_NAMES = ["README.md", "README.rst", "README.txt", "README", "CONTRIBUTING.md", "CONTRIBUTING.rst", "CHANGELOG.md", "CHANGELOG.rst", "CHANGES.md", "CHANGES.rst", "HISTORY.md", "HISTORY.rst", "AUTHORS.md", "AUTHORS.rst", "SECURITY.md", "SECURITY.rst"]
DOC_EXTENSIONS = [".md", ".rst", ".txt"]
TEST_DIRECTORIES = ["tests", "test", "__tests__", "spec", "__spec__"]
TEST_PREFIXES = ["test_", "_test.", "_spec.", ".test.", ".spec."]
TEST_SUFFIXES = ["_test.py", "_test.js", "_test.ts", "_test.tsx", "_test.jsx", ".test.js", ".test.ts", ".test.tsx", ".test.jsx", ".spec.js", ".spec.ts", ".spec.tsx", ".spec.jsx"]
SOURCE_EXTENSIONS = [
    ".py", ".js", ".jsx", ".ts", ".tsx", ".c", ".cpp", ".h", ".hpp", ".cs", ".java", ".kt", ".kts", ".go", ".rs", ".rb", ".php", ".swift", ".m", ".mm", ".sql", ".graphql", ".gql", ".sh", ".bash",
    ".zsh", ".vue", ".svelte",
]

# Words that are not calls or names of a repository.
PY_CALL_KEYWORDS = ["if", "for", "while", "with", "def", "class", "return", "import", "from", "elif", "else", "try", "except", "raise", "and", "or", "not", "in", "is", "lambda", "yield", "assert", "del", "print", "True", "False", "None", "self", "cls", "pass", "break", "continue", "global", "nonlocal", "super"]
JS_CALL_KEYWORDS = [
    "function", "const", "let", "var", "new", "async", "await", "export", "default", "switch", "case", "break", "continue", "if", "else", "for", "while", "do", "return", "throw", "try", "catch",
    "finally", "class", "extends", "super", "this", "typeof", "instanceof", "void", "delete", "in", "of", "with", "yield", "import", "from", "as", "static", "get", "set",
]
PY_REFERENCE_KEYWORDS = ["if", "for", "while", "with", "def", "class", "return", "import", "from", "elif", "else", "try", "except", "raise", "and", "or", "not", "in", "is", "lambda", "yield", "assert", "del", "print", "True", "False", "None", "self", "cls", "pass", "break", "continue", "global", "nonlocal"]
JS_REFERENCE_KEYWORDS = [
    "function", "const", "let", "var", "new", "async", "await", "export", "default", "switch", "case", "break", "continue", "if", "else", "for", "while", "do", "return", "throw", "try", "catch",
    "finally", "class", "extends", "super", "this", "typeof", "instanceof", "void", "delete", "in", "of", "with", "yield", "import", "from", "as", "static",
]
PY_BUILTINS = [
    "len", "range", "str", "int", "float", "bool", "dict", "list", "set", "tuple", "type", "isinstance", "getattr", "setattr", "hasattr", "iter", "next", "min", "max", "sum", "input", "open",
    "enumerate", "zip", "map", "filter", "sorted", "reversed", "any", "all", "abs", "round", "format", "repr", "print", "staticmethod", "classmethod", "property", "object", "Exception", "ValueError",
    "TypeError", "KeyError", "RuntimeError", "_", "__name__",
]
JS_BUILTINS = [
    "console", "JSON", "Math", "Object", "Array", "String", "Number", "Boolean", "parseInt", "parseFloat", "isNaN", "fetch", "setTimeout", "setInterval", "clearTimeout", "clearInterval", "Promise",
    "Symbol", "RegExp", "Date", "Error", "TypeError", "require", "module", "exports", "window", "document", "process", "undefined", "globalThis", "_",
]

# Search ranks of symbol kinds (2 for others).
KIND_RANK = {"FUNCTION": 10, "ASYNC_FUNCTION": 10, "METHOD": 10, "CLASS": 9, "INTERFACE": 9, "ENUM": 8, "TYPE_ALIAS": 8, "VARIABLE": 7, "CONSTANT": 7, "IMPORT": 0, "EXPORT": 0, "PARAMETER": 1, "LOCAL": 1}

# What an ECMAScript import without an extension may mean, in order; what a default export may be.
SCRIPT_SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
DEFAULT_EXPORT_KINDS = ["FUNCTION", "ASYNC_FUNCTION", "ARROW_FUNCTION", "CLASS", "INTERFACE", "ENUM"]
SOLE_EXPORT_KINDS = ["FUNCTION", "ASYNC_FUNCTION", "ARROW_FUNCTION", "CLASS"]

# Secrets.
SECRET_KEY = r"(?i)(api[_-]?key|password|passwd|pwd|token|secret|private[_-]?key)"
SECRET_ASSIGNMENT = r"""(?i)(api[_-]?key|password|passwd|secret[_-]?key|secret|token|private[_-]?key)\s*[:=]+\s*["']?[^"'\s,;}]+["']?"""
LOG_KEYS = ["API_KEY", "APISECRET", "ACCESS_TOKEN", "AUTH_TOKEN", "AUTHORIZATION", "SECRET", "SECRET_KEY", "PRIVATE_KEY", "PASSWORD", "PASSWD", "CREDENTIALS", "COOKIE"]
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f￾￿]"

# Names of revisions.
REVISION = r"^[A-Za-z0-9][A-Za-z0-9._/@{}^~+-]*$"

# Traversal and review.
EDGE_PRIORITY = {"TESTS": 0, "CALLS": 1, "REFERENCES": 2, "EXTENDS": 3, "IMPLEMENTS": 4, "IMPORTS": 5}
CONTAINER_KINDS = ["CLASS", "INTERFACE"]
PRIORITY_ORDER = {"REQUIRED": 0, "RECOMMENDED": 1, "INFORMATIONAL": 2}
ITEM_ORDER = {"CHANGED_CODE": 0, "AFFECTED_CALLER": 1, "AFFECTED_DEPENDENCY": 2, "AFFECTED_TEST": 3, "CONFIGURATION_CHANGE": 4, "UNRESOLVED_IMPACT": 5, "EXTERNAL_DEPENDENCY": 6, "DOCUMENTATION_CHANGE": 7}
BEHAVIOUR = ["CALLS", "REFERENCES", "EXTENDS", "IMPLEMENTS"]
RELATION_LABELS = {"CALLS": "callers", "REFERENCES": "dependents", "EXTENDS": "subclasses", "IMPLEMENTS": "implementers", "IMPORTS": "dependent files", "TESTS": "tests"}
LIMITS = {"impact_nodes": 1000, "impact_paths": 200, "unresolved": 500, "depth": 6, "review_entries": 200, "review_items": 300, "edges": 100_000, "symbol_candidates": 5000, "file_candidates": 2000, "text_bytes": 32 << 20, "text_hits": 1000, "snippet": 220, "query_chars": 200, "context_chars": 12_000, "context_items": 100}

# states that an update may set, and how much of a note is kept
ITEM_STATES = ["OPEN", "IN_PROGRESS", "DONE", "SKIPPED"]
ENTRY_STATES = ["OPEN", "DONE"]
NOTE_CHARS = 4000

# a diff: files, hunks, changed lines and bytes of its text
DIFF_LIMITS = {"files": 500, "hunks": 5000, "lines": 50_000, "bytes": 16 << 20}

# an explanation: characters of the summary, of the uncertainty and of a check, checks, selected indices
EXPLANATION_LIMITS = {"summary": 700, "uncertainty": 400, "check": 200, "checks": 4, "indices": 6}

"""Names, word lists and patterns whose exact text decides the results.

Every value in this file must stay as it is for results to agree with the behaviour the
engine reproduces; nothing here is logic.  Patterns are written in Python `re` syntax and are
turned into Spark (Java) patterns by :mod:`siftwork.functions.regex`.
"""

from __future__ import annotations

from typing import NamedTuple

# --------------------------------------------------------------------------- fixed values
# Platform labels in tie-break order, each with its detection patterns.  The number of patterns
# of a platform is the denominator of its confidence.
PLATFORM_PATTERNS: dict[str, tuple[str, ...]] = {
    "claude": (
        r"anthropic",
        r"claude",
        r"Assistant is a large language model trained by Anthropic",
        r"claude\.ai",
        r"CLAUDE\.md",
    ),
    "openai": (
        r"openai",
        r"gpt-?[34]",
        r"chatgpt",
        r"openai\.api_key",
        r"OPENAI_API_KEY",
        r"gpt-4o",
    ),
    "cursor": (
        r"\.cursorrules",
        r"cursor\s*rules",
        r"cursorai",
        r"cursor\.sh",
    ),
    "copilot": (
        r"github\s*copilot",
        r"copilot-instructions",
        r"copilot\.md",
    ),
    "langchain": (
        r"langchain",
        r"from langchain",
        r"import langchain",
        r"LLMChain",
        r"AgentExecutor",
    ),
    "crewai": (
        r"crewai",
        r"from crewai",
        r"import crewai",
        r"CrewAI",
        r"crew\.kickoff",
    ),
    "cline": (
        r"\.clinerules",
        r"cline",
    ),
    "gemini": (
        r"gemini",
        r"google\.generativeai",
        r"bard",
    ),
}

UNKNOWN_PLATFORM = "unknown"

# Technology keywords, in output order; plain substrings of the lower-cased text.
TECH_KEYWORDS: tuple[str, ...] = (
    "python",
    "typescript",
    "javascript",
    "rust",
    "go",
    "java",
    "react",
    "nextjs",
    "fastapi",
    "django",
    "flask",
    "langchain",
    "crewai",
    "llamaindex",
    "docker",
    "kubernetes",
    "aws",
    "gcp",
    "azure",
)

# Prompt-block patterns, in output order (ignore case, dot matches newline).
PROMPT_ASSIGN = r"(?:system\s*prompt|system_prompt)\s*[:=]\s*[\"']?(.*?)[\"']?\s*(?:\n|$)"
PROMPT_SECTION = r"(?:##?\s*(?:Instructions?|Rules?|Prompt|System\s*Prompt))\s*\n+(.*?)(?=\n##?|\Z)"
PROMPT_SYSTEM_TAG = r"<system>(.*?)</system>"
PROMPT_PERSONA_SPAN = r"(?:You are|Act as|Assistant is)\s.{0,400}"
# Markup elements whose inner text is a prompt block.
PROMPT_ELEMENTS: tuple[str, ...] = ("system", "prompt", "instructions")

# Persona line and constraint markers (ignore case), with the lengths they are cut to.
PERSONA = r"(?:^|\n)(You are[^\n]{0,300})"
PERSONA_CHARS = 200
CONSTRAINT = r"(?:do\s*not|never|avoid|must\s*not|refus[ei]|prohibit)[^\n.]{0,200}"
CONSTRAINT_STARTS = ("do", "never", "avoid", "must", "refus", "prohibit")
CONSTRAINT_CHARS = 150

TAG_PERSONA = "has-persona"
TAG_CONSTRAINTS = "has-constraints"
TAG_PROMPT = "has-system-prompt"


class SecretRule(NamedTuple):
    """One credential rule.

    ``needles`` are lower-case literals of which at least one occurs in every match; they only
    let the scan skip a document early.  Leave them empty if no such literal exists.
    """

    name: str
    pattern: str
    description: str
    ignore_case: bool = False
    min_entropy: float = 0.0
    needles: tuple[str, ...] = ()


# Credential rules in report order.
SECRET_RULES: tuple[SecretRule, ...] = (
    SecretRule(
        "openai_api_key",
        r"sk-[A-Za-z0-9]{32,48}",
        "OpenAI API key",
        needles=("sk-",),
    ),
    SecretRule(
        "anthropic_api_key",
        r"sk-ant-[A-Za-z0-9\-_]{20,}",
        "Anthropic API key",
        ignore_case=True,
        needles=("sk-ant-",),
    ),
    SecretRule(
        "github_token",
        r"gh[pousr]_[A-Za-z0-9]{36,}",
        "GitHub personal access token",
        ignore_case=True,
        needles=("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    ),
    SecretRule(
        "aws_access_key",
        r"AKIA[A-Z0-9]{16}",
        "AWS access key ID",
        ignore_case=True,
        needles=("akia",),
    ),
    SecretRule(
        "aws_secret_key",
        r"(?:aws[_\-]?secret[_\-]?(?:access[_\-]?)?key)\s*[=:]\s*[\"']?[A-Za-z0-9/+=]{40}[\"']?",
        "AWS secret access key",
        ignore_case=True,
        needles=("awssecret", "aws_secret", "aws-secret"),
    ),
    SecretRule(
        "google_api_key",
        r"AIzaSy[A-Za-z0-9\-_]{33}",
        "Google API key",
        needles=("aizasy",),
    ),
    SecretRule(
        "huggingface_token",
        r"hf_[A-Za-z0-9]{34,}",
        "Hugging Face token",
        ignore_case=True,
        needles=("hf_",),
    ),
    SecretRule(
        "langsmith_api_key",
        r"ls__[A-Za-z0-9]{32}",
        "LangSmith API key",
        needles=("ls__",),
    ),
    SecretRule(
        "hardcoded_api_key_assignment",
        r"(?:api[_\-]?key|secret[_\-]?key|access[_\-]?token|auth[_\-]?token)"
        r"\s*[=:]\s*[\"']([A-Za-z0-9\-_\.]{16,})[\"']",
        "Key or token assigned as a literal",
        ignore_case=True,
        needles=(
            "apikey", "api_key", "api-key",
            "secretkey", "secret_key", "secret-key",
            "accesstoken", "access_token", "access-token",
            "authtoken", "auth_token", "auth-token",
        ),
    ),
    SecretRule(
        "placeholder_leak",
        r"\{\{\s*(?:OPENAI|ANTHROPIC|CLAUDE|GITHUB|AWS|GOOGLE|HF)[_A-Z]*\s*\}\}",
        "Unfilled credential placeholder",
        ignore_case=True,
        needles=("{{",),
    ),
    SecretRule(
        "env_var_exposure",
        r"(?:os\.environ|getenv|process\.env)\s*[\[\(][\"']"
        r"([A-Z_]{5,}(?:KEY|TOKEN|SECRET|PASSWORD|API)[A-Z_]*)[\"']",
        "Name of a sensitive environment variable",
        ignore_case=True,
        needles=("os.environ", "getenv", "process.env"),
    ),
    SecretRule(
        "high_entropy_secret",
        r"[A-Za-z0-9+/=\-_]{40,}",
        "Long token of high entropy",
        min_entropy=3.5,
    ),
)

CONTEXT_CHARS = 20

# File names expected in a repository, in report order.
TARGET_FILENAMES: tuple[str, ...] = (
    "CLAUDE.md",
    "AGENTS.md",
    ".cursorrules",
    "CURSOR.md",
    ".clinerules",
    "COPILOT.md",
    ".github/copilot-instructions.md",
    "system_prompt.md",
    "system_prompt.txt",
    "langchain_config.py",
    "langchain_config.yaml",
    "langchain_config.json",
    "crewai_config.yaml",
    "crewai_config.json",
    ".env.agents",
    "agent_config.json",
    "agent_config.yaml",
    "openai_config.json",
)

CONTENT_SIGNATURES: tuple[str, ...] = (
    "Assistant is a large language model trained by Anthropic",
    "You are an expert developer",
    "Rules for the agent",
    "You are a helpful assistant",
    "You are Claude",
    "Act as an AI assistant",
    "SYSTEM PROMPT",
    "System prompt:",
    "## Instructions",
    "## Rules",
    "langchain",
    "crewai",
    "openai.api_key",
    "anthropic_api_key",
)

TARGET_PATHS: tuple[str, ...] = (
    ".github/",
    ".cursor/",
    "prompts/",
    "agents/",
    "config/",
    "src/agents/",
    "docs/",
)

S3_TERMS: tuple[str, ...] = (
    "CLAUDE.md",
    "AGENTS.md",
    ".cursorrules",
    "system_prompt",
    "agent_config",
    "openai_config",
    "langchain_config",
    "crewai_config",
)

# Grids and pairs of the combined predicates.
GRID_FILENAMES: tuple[str, ...] = ("CLAUDE.md", "AGENTS.md", ".cursorrules")
GRID_SIGNATURES: tuple[str, ...] = (
    "You are an expert developer",
    "Rules for the agent",
    "Assistant is a large language model trained by Anthropic",
)
FILENAME_KEYWORD_PAIRS: tuple[tuple[str, str], ...] = (
    ("CLAUDE.md", "You are"),
    ("AGENTS.md", "Rules for the agent"),
    (".cursorrules", "You are an expert"),
    ("langchain_config.yaml", "langchain"),
    ("crewai_config.yaml", "crewai"),
)
EXTENSION_KEYWORD_PAIRS: tuple[tuple[str, str], ...] = (
    ("md", "system prompt"),
    ("md", "CLAUDE"),
    ("cursorrules", "rules"),
    ("yaml", "langchain"),
    ("yaml", "crewai"),
    ("json", "openai"),
)
CONTENT_FILETYPES: tuple[str, ...] = ("md", "txt", "yaml", "json")
PATH_FILETYPES: tuple[str, ...] = ("md", "txt")

CODE_HOST = "github.com"
RAW_CODE_HOST = "raw.githubusercontent.com"
SRC_HOST = "bitbucket.org"
S3_HOST = "s3.amazonaws.com"

# Hosts never kept among harvested links (bare names; a leading "www." is ignored).
EXCLUDED_HOSTS: tuple[str, ...] = (
    "google.com",
    "google.co.uk",
    "google.co.in",
    "accounts.google.com",
    "support.google.com",
    "maps.google.com",
    "bing.com",
    "duckduckgo.com",
    "yandex.com",
    "yandex.ru",
    "youtube.com",
    "wikipedia.org",
    "w3.org",
)

# Embedding and search sizes.
EMBEDDING_DIM = 512
DOCUMENT_BLOCKS = 3
DOCUMENT_RAW_CHARS = 4000
DOCUMENT_CHARS = 8000
EXCERPT_CHARS = 500
DEFAULT_COLLECTION = "document_vectors"
DEFAULT_TOP_K = 10
DEFAULT_PAGE = 100

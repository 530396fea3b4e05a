"""Literal texts with the awkward cases: case folding, odd white space, adjacent and overlapping
matches, every kind of line end.  Long tokens are assembled, never typed out."""

OPENAI = "sk-" + "Ab3d" * 9
GITHUB = "ghp_" + "Zx9" * 12
AWS = "AKIA" + "Q7" * 8

TEXTS = [
    "",
    "plain text without anything",
    "You are a helpful bot.\nDo not lie. Never give up\nmust  not  do that. REFUSE it, prohibited",
    "intro\nYOU ARE the one   \nYou are second",
    "xx You are not at a line start",
    "system prompt: \"be brief\"\nsystem_prompt='x'\nSYSTEM PROMPT = unicode space",
    "system prompt:\n\nvalue after blank lines\nmore",
    "# Rules\n\nfirst\nsecond\n## Instructions\nbody\n# Prompt\nlast one",
    "## System Prompt   \nbody to the end",
    "#Rule\nno\n#x",
    "<system>one</system> text <SYSTEM>two\nlines</SYSTEM>",
    "Act as an expert " + "y" * 500 + "\nAssistant is good",
    "aſſistant is folded, You are KKelvin",
    "a\rb\r\nc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k\n",
    "\n\n",
    "tail\n",
    "\x1c padded \x1f ",
    f"openai.api_key = '{OPENAI}'",
    f"{OPENAI}{OPENAI} {GITHUB}",
    f"{GITHUB} {GITHUB}{AWS}",
    f"id={AWS.lower()} and {AWS}",
    'aws_secret_access_key = "' + "wJ4+" * 10 + '"',
    'AWS-SECRET-KEY:' + "abCD" * 10,
    "K=AIzaSy" + "k3_" * 11,
    "aizasy" + "k3_" * 11,
    "hf_" + "Hf7" * 12 + " HF_" + "Hf7" * 12,
    "ls__" + "q8" * 16,
    "auth_token = \"" + "t0k." * 5 + "\" api-key:'" + "z" * 16 + "'",
    "{{ OPENAI_API_KEY }}{{CLAUDE}} {{other}}",
    "os.environ['OPENAI_API_KEY'] process.env(\"SOME_SECRET_NAME\") getenv('SHORT')",
    "A" * 40 + "\n0123456789abcdefGHIJKLMNOPQRSTUVWXYZ_-+=",
    "ANT=sk-ant-api03-" + "a1B2" * 6,
    "é" * 30 + OPENAI + "😀" * 30,
    "api_key =\n'" + "z" * 20 + "'",
    "go rust trust javascript déclinē cline Claude.AI gpt4 GPT-3 chatgpt bombard",
    "from crewai import Crew\ncrew.kickoff() langchain LLMChain",
    "github\tcopilot and cursor \n rules",
]

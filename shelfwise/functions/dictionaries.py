"""Word lists and display names."""

# Words that carry no subject.
FUNCTION_WORDS = """
a an and are as at be by for from has have how in into is it its of on or that the
to was were will with you your this these those we our us they them he she his her not no but if
then than there here when where which who whom whose what why all any both each few more most other
some such only own same so too very can just should now about above after again against because
before being below between during further off once out over under until while do does did doing
new like also via etc yet another go
""".split()
BOILERPLATE_WORDS = """
library libraries lib package packages module modules project projects
repo repository repositories tool tools toolkit simple easy fast small tiny lightweight modern
minimal collection curated based written using use used uses support supports supported
implementation code source open free version example examples demo best great powerful flexible
full complete unofficial official cross platform made built create creates created creating
help helps
""".split()
README_WORDS = """
https www com io img png badge badges shields readme install installation usage
license licence mit apache contributing changelog
""".split()
STOPWORDS = sorted({*FUNCTION_WORDS, *BOILERPLATE_WORDS, *README_WORDS})

LANG_PREFIX = "lang:"
TOPIC_PREFIX = "topic:"

# Spellings that stand for one term.
ALIASES = {
    "k8s": "kubernetes", "kube": "kubernetes", "kubectl": "kubernetes",
    "ml": "machinelearning", "ai": "artificialintelligence",
    "llm": "llm", "llms": "llm", "genai": "generativeai",
    "golang": "lang:go", "javascript": "lang:javascript", "js": "lang:javascript",
    "typescript": "lang:typescript", "ts": "lang:typescript", "py": "lang:python",
    "python": "lang:python", "rs": "lang:rust", "rust": "lang:rust", "rustlang": "lang:rust",
    "k3s": "kubernetes", "oci": "container", "docker": "container",
    "containers": "container", "containerd": "container",
    "cli": "commandline", "tui": "terminal", "cmdline": "commandline",
    "ci": "cicd", "devops": "cicd",
    "db": "database", "sql": "database", "dbs": "database",
    "sec": "security", "infosec": "security", "appsec": "security",
    "k6": "loadtesting", "otel": "opentelemetry",
    "prom": "prometheus", "graf": "grafana",
    "nvim": "vim", "neovim": "vim",
    "web3": "blockchain",
    "gh": "github", "gitops": "gitops",
}

# How terms are written on a label.
DISPLAY = {
    "kubernetes": "Kubernetes", "machinelearning": "Machine Learning",
    "artificialintelligence": "AI", "deeplearning": "Deep Learning",
    "generativeai": "Generative AI", "llm": "LLM", "commandline": "CLI",
    "cicd": "CI/CD", "javascript": "JavaScript", "typescript": "TypeScript",
    "opentelemetry": "OpenTelemetry", "graphql": "GraphQL", "postgresql": "PostgreSQL",
    "postgres": "Postgres", "nosql": "NoSQL", "grpc": "gRPC", "api": "API",
    "apis": "APIs", "sdk": "SDK", "http": "HTTP", "dns": "DNS", "tls": "TLS",
    "aws": "AWS", "gcp": "GCP", "css": "CSS", "html": "HTML", "json": "JSON",
    "yaml": "YAML", "wasm": "WebAssembly", "ebpf": "eBPF", "gpu": "GPU",
    "os": "OS", "rss": "RSS", "vpn": "VPN", "ssh": "SSH", "ui": "UI", "ux": "UX",
    "vim": "Vim", "neovim": "Neovim", "nixos": "NixOS", "macos": "macOS", "ios": "iOS",
    "imap": "IMAP", "smtp": "SMTP", "jmap": "JMAP", "pop3": "POP3", "mta": "MTA",
    "csv": "CSV", "xml": "XML", "ntp": "NTP", "smb": "SMB", "nfs": "NFS",
    "esp32": "ESP32", "esp8266": "ESP8266", "rfc": "RFC", "pdf": "PDF", "svg": "SVG",
    "oidc": "OIDC", "saml": "SAML", "ldap": "LDAP", "mqtt": "MQTT", "cve": "CVE",
    "sbom": "SBOM", "tui": "TUI", "ide": "IDE", "vm": "VM", "cpu": "CPU",
    "github": "GitHub", "gitlab": "GitLab", "gitops": "GitOps", "devsecops": "DevSecOps",
    "nodejs": "Node.js", "dotnet": ".NET", "cpp": "C++", "csharp": "C#", "fsharp": "F#",
    "lang:go": "Go", "lang:cpp": "C++", "lang:csharp": "C#",
    "lang:fsharp": "F#", "lang:c": "C", "lang:objectivec": "Objective-C",
    "lang:javascript": "JavaScript", "lang:typescript": "TypeScript",
    "lang:jupyternotebook": "Jupyter Notebook", "lang:vimscript": "Vim Script",
    "lang:emacslisp": "Emacs Lisp", "lang:powershell": "PowerShell",
    "lang:shell": "Shell", "lang:php": "PHP", "lang:sql": "SQL",
    "lang:html": "HTML", "lang:css": "CSS", "lang:scss": "SCSS",
    "lang:ocaml": "OCaml", "lang:matlab": "MATLAB", "lang:tex": "TeX",
    "lang:hcl": "HCL", "lang:rmarkdown": "R Markdown", "lang:r": "R",
}

# Labels that say how a project is run, not what it is about.
NOT_A_SUBJECT = """
hacktoberfest oss opensource sourceopen goodfirstissue helpwanted firsttimersonly
contribution contributor starred star todo wip misc stuff various
""".split()

# Headings that a section is passed over for.
SKIPPED_HEADINGS = [
    "installation", "install", "installing", "getting started", "setup",
    "usage", "quick start", "quickstart", "requirements", "prerequisites",
    "building", "build", "development", "contributing", "contributors",
    "license", "licence", "changelog", "table of contents", "contents",
    "acknowledgements", "acknowledgments", "credits", "sponsors", "support",
    "donate", "star history", "badges",
]

"""Package categories from metadata or from the attribute path."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Catalog category -> shown category.
CATEGORY_NAMES = {
    "applications.editors": "editors",
    "applications.graphics": "graphics",
    "applications.networking": "networking",
    "applications.science": "science",
    "applications.system": "system",
    "applications.virtualization": "virtualization",
    "applications.audio": "audio",
    "applications.video": "video",
    "applications.office": "office",
    "applications.misc": "applications",
    "development.tools": "development",
    "development.libraries": "libraries",
    "development.compilers": "compilers",
    "development.interpreters": "interpreters",
    "development.haskell-modules": "haskell",
    "development.python-modules": "python",
    "development.node-packages": "javascript",
    "development.r-modules": "r",
    "development.ocaml-modules": "ocaml",
    "development.perl-modules": "perl",
    "development.ruby-modules": "ruby",
    "games": "games",
    "servers": "servers",
    "tools.system": "system-tools",
    "tools.networking": "networking-tools",
    "tools.text": "text-tools",
    "tools.misc": "tools",
    "tools.security": "security",
    "tools.filesystems": "filesystems",
    "tools.backup": "backup",
    "data": "data",
    "fonts": "fonts",
    "themes": "themes",
}

# Category -> words looked for anywhere in the lower-case path; the first category wins.
PATH_RULES = {
    "python": ["python", "python3packages", "python2packages"],
    "haskell": ["haskellpackages", "haskell.packages"],
    "javascript": ["nodepackages", "node_"],
    "r": ["rpackages"],
    "perl": ["perlpackages", "perl5", "perl."],
    "ruby": ["rubypackages", "rubygems"],
    "ocaml": ["ocamlpackages", "ocaml-"],
    "lua": ["lua", "luapackages"],
    "go": ["go-modules", "buildgomodule"],
    "rust": ["rustpackages", "cargo"],
    "editors": ["editor", "vim", "emacs", "nano", "helix"],
    "browsers": ["browser", "firefox", "chrome", "webkit"],
    "games": ["game", "steam", "lutris"],
    "servers": ["server", "nginx", "apache", "httpd", "postgresql", "mysql"],
    "fonts": ["font", "fonts", "ttf", "otf"],
    "themes": ["theme", "gtk", "qt", "icon"],
    "multimedia": ["media", "video", "audio", "vlc", "ffmpeg"],
    "office": ["office", "libreoffice", "document"],
    "science": ["science", "math", "research", "latex"],
    "graphics": ["graphic", "image", "gimp", "inkscape", "photo"],
    "networking": ["network", "curl", "wget", "ssh", "tcp"],
    "system": ["system", "systemd", "util", "coreutils"],
    "security": ["security", "crypto", "ssl", "gpg", "password"],
    "backup": ["backup", "rsync", "sync"],
    "filesystems": ["filesystem", "fuse", "mount"],
    "compilers": ["compiler", "gcc", "clang", "llvm"],
    "interpreters": ["interpreter", "runtime"],
    "libraries": ["lib", "library", "shared"],
    "tools": ["tool", "util", "cli"],
    "development": ["devel", "dev", "build", "make", "cmake"],
}
DEFAULT_CATEGORY = "misc"


def category_name(category: Column) -> Column:
    """The shown name of a catalog category; unmapped ones pass through in lower case."""
    key = F.lower(category)
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(CATEGORY_NAMES.items())])
    return F.when(category == "", DEFAULT_CATEGORY).otherwise(F.coalesce(F.try_element_at(names, key), key))


def category_of_path(lower_path: str) -> Column:
    """The category of a column that holds lower-case attribute paths.

    Takes the column's name, so that the path is put in lower case once and not per word.
    """
    rules = " ".join(
        "WHEN " + " OR ".join(f"contains({lower_path}, '{word}')" for word in words) + f" THEN '{category}'"
        for category, words in PATH_RULES.items()
    )
    return F.expr(f"CASE {rules} ELSE '{DEFAULT_CATEGORY}' END")

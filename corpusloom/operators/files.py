"""Classifying files, trees of directories, project statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extensions by what a file holds, and names that decide by themselves.
CODE_EXTENSIONS = "py pyi ipynb js jsx ts tsx java kt kts go cpp cc cxx c h hpp rs swift rb php cs scala sh bash zsh ps1 sql r jl".split()
TEXT_EXTENSIONS = "md mdx markdown rst txt log tex yaml yml toml ini cfg json jsonc csv tsv env sample example adoc".split()
NOISE_EXTENSIONS = (
    "css scss sass less styl html htm xhtml xml svg png jpg jpeg gif webp bmp tiff avif ico woff woff2 eot ttf otf "
    "mp4 mp3 wav ogg webm avi mov pdf docx xlsx pptx doc xls ppt map snap patch"
).split()
CODE_NAMES = "dockerfile makefile cmakelists.txt build.gradle gradlew gradlew.bat package.json pnpm-workspace.yaml requirements.txt".split()
TEXT_NAMES = "changelog changelog.md readme readme.md".split()
SKIP_DIRS = ".git .github .gitlab .svn .hg .bzr".split()
SKIP_NAMES = "license license.txt license.md licence licence.txt licence.md copying copying.txt notice notice.txt patents".split()
SEARCH_SKIP_DIRS = ".git node_modules __pycache__ .venv venv dist build .next .cache coverage .idea .vscode target out .turbo .nuxt .output vendor".split()
BINARY_ENDINGS = ".pyc .pyo .so .o .a .dylib .jpg .jpeg .png .gif .ico .svg .woff .woff2 .ttf .eot .lock .map .min.js .min.css .faiss .pkl .npy .npz .bin .zip .tar .gz .bz2".split()
IMPORTANT_NAMES = (
    "README.md README.txt readme.md README.rst README requirements.txt Pipfile pyproject.toml setup.py setup.cfg package.json yarn.lock package-lock.json "
    "npm-shrinkwrap.json Dockerfile docker-compose.yml docker-compose.yaml .gitignore .gitattributes .dockerignore Makefile makefile CMakeLists.txt LICENSE LICENSE.txt "
    "LICENSE.md COPYING CHANGELOG.md CHANGELOG.txt HISTORY.md CONTRIBUTING.md CODE_OF_CONDUCT.md .env .env.example .env.local tox.ini pytest.ini .pytest.ini .flake8 "
    ".pylintrc mypy.ini go.mod go.sum Cargo.toml Cargo.lock pom.xml build.gradle build.gradle.kts composer.json composer.lock Gemfile Gemfile.lock"
).split()
README_NAMES = ("README.md", "readme.md", "README.rst", "README.txt")
SCAN_SKIP_DIRS = ("node_modules", "__pycache__", "venv", "env")
ENTRY_NAMES = (
    "main.py", "app.py", "index.py", "__main__.py", "manage.py", "wsgi.py", "asgi.py", "index.ts", "index.tsx", "index.js", "index.jsx", "main.ts", "main.tsx", "app.ts", "app.tsx",
    "server.ts", "server.js", "page.tsx", "layout.tsx", "route.ts", "route.tsx", "api.py", "routes.py", "urls.py", "views.py",
)
CONFIG_NAMES = (
    "package.json", "tsconfig.json", "next.config.js", "next.config.ts", "vite.config.ts", "vite.config.js", "webpack.config.js", "pyproject.toml", "setup.py", "requirements.txt",
    ".env.example", "docker-compose.yml", "Dockerfile",
)
MARKDOWN_EXTENSIONS = ("md", "mdx", "markdown", "rst")
MOST_BYTES = 2 << 20


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """The lower-case extension without its dot; empty for names without one, or that only begin with a dot."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+\.([^.]*)$", 1))


def is_binary(content: Column) -> Column:
    """A zero byte among the first 1024, or no content."""
    return F.coalesce(F.position(F.lit(b"\x00"), F.substring(content, 1, 1024)) > 0, F.lit(True))


def glob_regex(globs: list[str]) -> str:
    """One pattern for a list of globs: * crosses directories, ? is a character, [..] a class."""
    out = []
    for g in globs:
        g = g.removeprefix("./").rstrip("/")
        p, i = "", 0
        while i < len(g):
            end = g.find("]", i + 2) if g[i] == "[" else -1
            if end > 0:
                body = g[i + 1 : end].replace("\\", "\\\\")
                p += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
                i = end
            else:
                p += {"*": "(?s:.*)", "?": "(?s:.)"}.get(g[i]) or (g[i] if g[i].isalnum() or g[i] in "_/" else "\\" + g[i])
            i += 1
        out.append(p)
    return "^(?:" + "|".join(out) + ")$"


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether the path, its name, or a directory above it matches a glob."""
    p = glob_regex(globs)
    above = F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda i: F.array_join(F.slice(F.split(path, "/"), F.lit(1), i), "/"))
    return F.exists(above, lambda a: a.rlike(p)) | F.exists(F.split(path, "/"), lambda a: a.rlike(p))


def included(path: Column, globs: list[str]) -> Column:
    """Whether the name matches one of the globs; without globs every file does."""
    return name_of(path).rlike(glob_regex(globs)) if globs else F.lit(True)


def scanned(path: Column) -> Column:
    """Whether a scan for source files takes the path: nothing hidden, no installed packages, no virtual environment."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return ~F.exists(parts, lambda x: x.startswith(".")) & ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in SCAN_SKIP_DIRS]))


def listing(paths: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """The paths outside of skipped directories, of the given extensions if any, in order."""
    folders = F.split(folder_of(F.col("path")), "/")
    out = paths.where(~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in SEARCH_SKIP_DIRS])))
    return (out.where(extension(F.col("path")).isin(*extensions)) if extensions else out).select("path").orderBy("path")


def named_files(paths: DataFrame, pattern: str, most: int = 10) -> DataFrame:
    """The first paths whose name matches a glob."""
    return paths.where(included(F.col("path"), [pattern])).select("path").orderBy("path").limit(most)


def project_files(paths: DataFrame) -> DataFrame:
    """kind (entry or config) and path of the files that start or set up a program."""
    name = name_of(F.col("path"))
    kinds = F.array_compact(F.array(F.when(name.isin(*ENTRY_NAMES), "entry"), F.when(name.isin(*CONFIG_NAMES), "config")))
    return listing(paths).select(F.explode(kinds).alias("kind"), "path").distinct()


def split_route(path: Column) -> Column:
    """markdown or plain_text, by extension."""
    return F.when(extension(path).isin(*MARKDOWN_EXTENSIONS), "markdown").otherwise("plain_text")


def kept(path: Column) -> Column:
    """Not under a directory of version control, nor a legal text by name."""
    return ~F.arrays_overlap(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*[F.lit(x) for x in SKIP_DIRS])) & ~F.lower(name_of(path)).isin(SKIP_NAMES)


def category(path: Column) -> Column:
    """code, text, or null for noise; unknown files are text."""
    name, ext = F.lower(name_of(path)), extension(path)
    return (
        F.when(name.isin(CODE_NAMES), "code").when(name.isin(TEXT_NAMES), "text").when(ext.isin(CODE_EXTENSIONS), "code").when(ext.isin(TEXT_EXTENSIONS), "text").when(ext.isin(NOISE_EXTENSIONS), None).otherwise("text")
    )


def is_important(path: Column) -> Column:
    name, folder = name_of(path), folder_of(path)
    ends = lambda *e: name.rlike(r"\.(" + "|".join(e) + ")$")
    placed = ((folder == ".github/workflows") & ends("yml", "yaml")) | ((folder == ".github") & ends("md", "yml", "yaml")) | ((folder == "docs") & ends("md", "rst", "txt"))
    return placed | name.isin(IMPORTANT_NAMES)


def searchable(path: Column, size: Column) -> Column:
    """In no skipped or hidden directory, not hidden, of no binary ending, at most 2 MiB."""
    parts = F.split(path, "/")
    ends = F.lit(False)
    for e in BINARY_ENDINGS:
        ends = ends | F.lower(path).endswith(e)
    return ~F.exists(parts, lambda x: x.isin(SEARCH_SKIP_DIRS) | x.startswith(".")) & ~ends & (size <= MOST_BYTES)


def under(path: Column, root: str) -> Column:
    """Whether a path stays below root; paths with .. segments don't."""
    return ~F.array_contains(F.split(path, "/"), "..") & (path.startswith(root.rstrip("/") + "/") | (path == root.rstrip("/")))


def tree(paths: DataFrame) -> DataFrame:
    """path, depth, is_dir and last (of its directory) for each directory and file, directories first, then by lower-case name."""
    parts = F.split("path", "/")
    lead = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), i.alias("depth"), (i < F.size(parts)).alias("is_dir")))).alias("x"))
    nodes = lead.select("x.*").groupBy("path", "depth").agg(F.bool_or("is_dir").alias("is_dir")).withColumn("parent", folder_of(F.col("path")))
    order = Window.partitionBy("parent").orderBy(F.desc("is_dir"), F.lower(name_of(F.col("path"))), "path")
    return nodes.withColumns({"place": F.row_number().over(order), "last": F.lead("path").over(order).isNull()})

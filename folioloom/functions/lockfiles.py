"""Dependency lockfile names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioloom.functions.patterns import quote

# A path is a lockfile when its lower-cased form ends with one of these.
LOCKFILE_SUFFIXES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json", "bun.lockb", "deno.lock",
    "composer.lock",
    "gemfile.lock",
    "poetry.lock", "pipfile.lock", "pdm.lock", "uv.lock", "conda-lock.yml", ".req.lock",
    "go.sum", "gopkg.lock", "glide.lock",
    "gradle.lockfile", "pom.xml.lock",
    "dependency-lock.json",
    "packages.lock.json", "paket.lock", "project.assets.json",
    "package.resolved", "podfile.lock", "cartfile.resolved",
    "mix.lock",
    "rebar.lock",
    "pubspec.lock",
    "stack.yaml.lock", "cabal.project.freeze",
    "cargo.lock",
    "flake.lock",
    "cpanfile.snapshot", "MYMETA.yml", "MYMETA.json",
    "renv.lock", "packrat/packrat.lock",
    "manifest.toml",
    ".terraform.lock.hcl", "Pulumi.lock.yaml", "Chart.lock", "Berksfile.lock", "Puppetfile.lock",
    "shard.lock",
    "conan.lock", "cpm.cmake.lock", "subprojects/packagecache.json",
    "platformio.lock",
    "luarocks.lock",
    "elm-stuff/exact-dependencies.json",
    "esy.lock/index.json", "opam.lock", "*.opam.locked",
    "nimble.lock",
    "dub.selections.json",
    "zig.lock",
    "haxelib.lock",
    "v.lock",
    "qlfile.lock",
    "module.bazel.lock",
    "Brewfile.lock.json",
)


def is_lockfile(path: Column, any_case: bool = False) -> Column:
    """Suffix test on the lower-cased path.

    The entries written with capitals can never equal lower-cased text; `any_case=True` lower-cases them too. Only the
    tail that the longest entry can cover is looked at, once, whatever expression the path comes from.
    """
    names = [s.lower() if any_case else s for s in LOCKFILE_SUFFIXES]
    tail = F.lower(F.translate(F.right(path, F.lit(max(map(len, names)))), "\\", "/"))
    return tail.rlike(f"(?:{'|'.join(map(quote, names))})\\z")

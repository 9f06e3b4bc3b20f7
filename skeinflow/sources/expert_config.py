"""The default experts: the configuration that ``tables.experts`` reads where no other is given."""

from __future__ import annotations

import json

#: Experts, and the words that name them.
EXPERTS = (
    {
        "id": "experto-en-neovim", "name": "Neovim", "collection_name": "neovim_docs", "knowledge_base": "the official Neovim documentation and community plugins",
        "keywords": (
            "neovim", "nvim", "vimrc", "init.lua", "lazy.nvim", "vim-plug", "treesitter", "keymap", "which-key",
        ),
    },
    {
        "id": "experto-en-arch-linux", "name": "Arch Linux", "collection_name": "archwiki", "knowledge_base": "the official Arch Linux wiki",
        "keywords": (
            "archlinux", "pacman", "yay", "aur", "systemd", "grub", "hyprland", "wayland",
        ),
    },
    {
        "id": "arquitecto-de-codigo", "name": "Arquitecto de código", "collection_name": None, "knowledge_base": None,
        "keywords": (
            "architecture", "arquitectura", "design pattern", "patrón de diseño", "microservices", "microservicios", "system design",
            "diseño de sistemas", "scalability", "escalabilidad", "ddd", "domain driven design", "event sourcing", "c4 model", "modelo c4",
            "monolith", "monolito", "orchestration", "orquestación", "saga", "cqrs", "trade-off", "clean architecture", "arquitectura limpia",
            "hexagonal", "onion architecture", "architectural decision record", "adr", "component diagram", "diagrama de componentes",
        ),
    },
    {
        "id": "progrmador", "name": "Programador", "collection_name": None, "knowledge_base": None,
        "keywords": (
            "function", "función", "class", "clase", "algorithm", "algoritmo", "debug", "depurar", "bug", "implement", "implementar", "python",
            "javascript", "api", "script", "optimize", "optimizar", "refactor", "refactorizar", "snippet", "fragmento", "error", "excepción",
            "library", "librería", "framework", "endpoint", "test", "prueba unitaria",
        ),
    },
)


def as_json() -> str:
    """The configuration as a JSON text."""
    return json.dumps(EXPERTS, ensure_ascii=False)

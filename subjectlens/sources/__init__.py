"""Readers and writers of files: texts, archives, robots rules, exports, marked-up pages, vectors."""

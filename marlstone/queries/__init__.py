"""Registered queries of the core, by area; importing a module registers its queries."""

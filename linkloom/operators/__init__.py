"""Operators over items, links, attempts and stores."""

"""From query text to syntax trees."""

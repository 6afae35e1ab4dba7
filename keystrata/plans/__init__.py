"""From declarative query parts to DataFrame plans."""

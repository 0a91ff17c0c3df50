"""Set-oriented operators: tables in, tables out."""

"""Reading pages, robots rules, sitemaps and stores."""

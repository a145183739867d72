"""Texts with their personal data that the base patterns miss, written by hand and not by the generator's rules: (text, [(piece, kind)])."""

LABELLED = [
    ("You can ring me on 020 7946 0958 after six.", [("020 7946 0958", "phone")]), ("Office: (415) 555-0132, ask for Ines.", [("(415) 555-0132", "phone")]), ("Call 555-867-5309 for a quote", [("555-867-5309", "phone")]),
    ("Fax 0228/997799, room 4", [("0228/997799", "phone")]), ("tel. 030/1234567", [("030/1234567", "phone")]), ("Mobile: 415.555.0132.", [("415.555.0132", "phone")]), ("phone 0171 5550123", [("0171 5550123", "phone")]),
    ("Please dial (212) 555-0187 or (646) 555-0101.", [("(212) 555-0187", "phone"), ("(646) 555-0101", "phone")]), ("Téléphone : 01 44 55 66 77", [("01 44 55 66 77", "phone")]), ("My cell is 917-555-0143!", [("917-555-0143", "phone")]),
    ("Telefon 089 / 636 48018", [("089 / 636 48018", "phone")]), ("Reach us: tel 0049 30 901820", [("0049 30 901820", "phone")]), ("contact desk (303) 555-0175 ext 12", [("(303) 555-0175", "phone")]), ("teléfono 91 411 1111", [("91 411 1111", "phone")]),
    ("Her number is 202-555-0156, his 202-555-0157.", [("202-555-0156", "phone"), ("202-555-0157", "phone")]), ("whatsapp 0612345678", [("0612345678", "phone")]),
    ("card 4111.1111.1111.1111 exp 12/27", [("4111.1111.1111.1111", "card")]), ("Visa: 4012/8888/8888/1881", [("4012/8888/8888/1881", "card")]), ("paid by credit card 5555.5555.5555.4444", [("5555.5555.5555.4444", "card")]),
    ("Mastercard 5105.1051.0510.5100 was declined", [("5105.1051.0510.5100", "card")]), ("Karte 4242/4242/4242/4242", [("4242/4242/4242/4242", "card")]),
    ("write to jane (at) example (dot) com", [("jane (at) example (dot) com", "email")]), ("jane.doe[at]example[dot]org", [("jane.doe[at]example[dot]org", "email")]), ("mail: kim at example dot net", [("kim at example dot net", "email")]),
    ("Contact Bob AT Widgets DOT com today", [("Bob AT Widgets DOT com", "email")]), ("sales(at)shop(dot)example(dot)de", [("sales(at)shop(dot)example(dot)de", "email")]), ("info{at}museum{dot}org", [("info{at}museum{dot}org", "email")]),
    ("my mail is r.smith99 (at) mail (dot) example (dot) com.", [("r.smith99 (at) mail (dot) example (dot) com", "email")]), ("correo ana [at] ejemplo [dot] es", [("ana [at] ejemplo [dot] es", "email")]),
    ("host 192[.]168[.]1[.]77 was seen", [("192[.]168[.]1[.]77", "ip")]), ("beacon to 203(.)0(.)113(.)9", [("203(.)0(.)113(.)9", "ip")]), ("ping 8[.]8[.]8[.]8", [("8[.]8[.]8[.]8", "ip")]), ("C2 at 198[dot]51[dot]100[dot]23", [("198[dot]51[dot]100[dot]23", "ip")]),
    ("server 999[.]1[.]1[.]1 is no address", []), ("login from 10[.]20[.]30[.]40 and 10[.]20[.]30[.]41", [("10[.]20[.]30[.]40", "ip"), ("10[.]20[.]30[.]41", "ip")]),
    ("Order 2024-10-12-0045 shipped.", []), ("ISBN 978-3-16-148410-0", []), ("version 10.4.2.118", []), ("On 12/10/2024 14:30 we met.", []), ("pages 1021-1045, vol. 12", []), ("The years 1914-1918 and 1939-1945", []),
    ("coordinates 52.5200, 13.4050", []), ("IBAN has 22 places", []), ("Total: $1,299.00 for 3 items", []), ("invoice no 20240017", []), ("Part 8841-22-1", []), ("He stopped at the corner. Dot your i's.", []), ("score 21-14 21-19", []),
    ("population 1 234 567", []), ("2023-01-01 to 2023-12-31", []), ("lot 55512345", []), ("id 100200300400", []), ("in room 12, floor 3, at 9.30", []), ("0.0001 0.0002 0.0003 0.0004", []), ("we look at points dot by dot", []),
    ("order 4111111111111112 failed", []), ("see §§ 812-822 and 985-1004", []), ("timestamps 1700000000 1700000060", []), ("date 2022/11/05, time 10.15", []), ("zip 90210-1234", []), ("serial 12-3456-7890-12", []), ("chapter 3.2.1.4 of the book", []),
]
